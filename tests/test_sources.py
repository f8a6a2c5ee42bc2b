"""Data set, store and stream on small frames."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumigrid.model import PIXELS, GraphConfig
from lumigrid.operators import grid, metrics, regions
from lumigrid.operators.segment import segment
from lumigrid.sources import dataset, images, store
from lumigrid.streaming.images import segment_stream


def image(h=8, w=9, image_id=1, step=1.0):
    r, c = np.mgrid[1 : h + 1, 1 : w + 1]
    left = (c <= w // 2).ravel()
    return pd.DataFrame({
        "image_id": image_id, "pid": ((c - 1) * h + r).ravel(), "row": r.ravel(), "col": c.ravel(), "c1": np.where(left, 0.1, 0.9), "c2": 0.5, "c3": 0.5,
        "x": c.ravel() * 0.01, "y": r.ravel() * 0.01, "z": np.where(left, 1.0, 1.0 + step), "nx": 0.0, "ny": 0.0, "nz": -1.0, "label": np.where(left, 1, 2),
    })


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame(image(), PIXELS)


def test_edge_count(spark):
    for h, w in ((3, 3), (1, 5), (5, 1), (4, 7)):
        df = spark.createDataFrame(image(h, w), PIXELS)
        assert grid.edges(df).count() == 4 * h * w - 3 * h - 3 * w + 2


def test_planes_face_the_camera(pixels):
    n = grid.planes(pixels, 1, 0.1).toPandas()
    np.testing.assert_allclose(n[["nx", "ny", "nz"]].to_numpy(), np.tile([0, 0, -1.0], (len(n), 1)), atol=1e-6)


def test_graph_segments_find_the_step(pixels):
    got = segment(pixels, GraphConfig(scale_k=0.5, min_size=3)).toPandas().merge(pixels.toPandas(), on="pid")
    assert got.groupby("label_y")["label_x"].nunique().max() == 1 and got["label_x"].nunique() == 2


def test_metrics_of_equal_labellings(pixels):
    t = metrics.contingency(pixels, pixels)
    assert metrics.rand_index(t).first()["value"] == 1.0
    assert metrics.variation_of_information(t).first()["value"] == pytest.approx(0)
    rows = metrics.supervised(pixels, pixels, "same").toPandas().set_index("metric")["value"]
    assert rows["FBoundary"] == 1.0 and rows["BoundaryDisplacementError"] == 0.0
    assert metrics.unsupervised(pixels, "same").count() == 7


def test_empty_frames(spark):
    empty = spark.createDataFrame([], PIXELS)
    for f in (grid.weights, grid.median3x3, regions.summary, regions.components, lambda d: segment(d, GraphConfig())):
        assert f(empty).count() == 0


def test_dataset(spark, tmp_path):
    rgb, xyz, labels = np.zeros((3, 40, 41), np.uint8), np.ones((3, 40, 41)), np.zeros((40, 41), np.int32)
    for k in (1, 2):
        (tmp_path / f"image_nyu_v2_{k}.fits").write_bytes(dataset.fits_bytes([rgb, xyz, labels]))
    data = dataset.Dataset(spark, str(tmp_path / "set"))
    source = dataset.read_fits(spark, str(tmp_path))
    data.preprocess(source, 1)
    assert len(data) == 1
    data.preprocess(source)
    assert len(data) == 2
    one = data[2].toPandas()
    assert len(one) == (40 - 29) * (41 - 29) and set(one["label"]) == {1} and one["row"].min() == 1


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    rows = store.with_id(spark.createDataFrame([("CDN", {"k": "1"}), ("GCF", {"k": "2"})], "name string, params map<string,string>"), ["name", "params"])
    rows = rows.select("id", "name", "params")
    for _ in range(2):
        s.insert("algorithm", store.ALGORITHM, rows, ["id"])
    table = s.read("algorithm", store.ALGORITHM)
    assert table.count() == 2 and store.exists(table, name="CDN") and not store.exists(table, name="X")
    assert store.get(table, name="GCF")["params"] == {"k": "2"}
    with pytest.raises(LookupError):
        store.get(table, name="X")
    m = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 3.0})], "a map<string,double>, b map<string,double>")
    assert m.select(store.merged_metrics("a", "b").alias("m")).first()["m"] == {"a": 1.0, "b": 3.0}


def test_segments_saved_and_painted(spark, tmp_path, pixels):
    s = store.Store(spark, str(tmp_path / "store"))
    s.save_segments(pixels.select("image_id", "pid", "label"), regions.summary(pixels), 7)
    assert s.load_segments(1, 7).count() == pixels.count()
    assert bytes(dataset.painted_png(pixels, regions.summary(pixels)).first()["png"]).startswith(b"\x89PNG")


def test_many_images_are_saved_in_few_files(spark, tmp_path):
    """Folders hold ranges of images; saving some of them again leaves the others as they were."""
    s = store.Store(spark, str(tmp_path / "store"))
    rows = lambda images, label: spark.createDataFrame([(i, p, label) for i in images for p in (1, 2)], "image_id long, pid long, label int")
    means = lambda df: df.groupBy("image_id", "label").count()
    for images, label, number in ((range(990, 1090), 1, 7), (range(1000, 1010), 2, 7), (range(985, 995), 3, 8)):
        df = rows(images, label)
        s.save_segments(df, means(df), number)
    assert s.files("labels").where("path LIKE '%.parquet'").count() <= 3 * store.WRITERS
    expected = sorted((i, p, 2 if 1000 <= i < 1010 else 1) for i in range(990, 1090) for p in (1, 2))
    assert sorted(map(tuple, s.labels(7).select("image_id", "pid", "label").collect())) == expected
    assert s.labels(8).count() == 20 and s.labels(9) is None
    assert [r["label"] for r in s.load_segments(1005, 7).collect()] == [2, 2] and s.load_segments(1005, 8).count() == 0
    assert s.stored(spark.createDataFrame([(7, 990), (8, 990), (8, 1000)], "algorithm_id long, image_id long")).count() == 2
    assert sorted({(r["image_id"], r["label"], r["count"]) for r in s._segments("regions").where("algorithm_id = 7").collect()}) == sorted({(i, k, 2) for i, _, k in expected})


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(image(), PIXELS).write.parquet(source)
    segment_stream(spark, source, target, str(tmp_path / "check"), GraphConfig(scale_k=0.5, min_size=3)).awaitTermination()
    assert spark.read.parquet(f"{target}/regions").agg(F.sum("cnt")).first()[0] == 72


def test_image_files_are_pruned(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(pd.concat([image(4, 5, k) for k in range(1, 6)]), PIXELS)
    images.saved(df, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [images.file_of(k) for k in range(1, 6)]
    whole = images.images(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("nx", "ny", "nz").collect())) == sorted(map(tuple, df.drop("nx", "ny", "nz").collect()))
    (tmp_path / images.file_of(2)).write_bytes(b"not an image")
    some = images.images(spark, str(tmp_path), ("image_id", "pid", "label")).where("image_id IN (1, 3) AND label = 2")
    assert sorted(r["image_id"] for r in some.collect()) == [1] * 12 + [3] * 12
    assert images.images(spark, str(tmp_path), ("image_id",)).where("image_id > 4").count() == 20
    assert images.images(spark, str(tmp_path)).where("image_id > 99").count() == 0


def test_parts_that_no_column_needs_are_not_read(spark, tmp_path):
    images.saved(spark.createDataFrame(image(4, 5, 1), PIXELS), str(tmp_path))
    file = tmp_path / images.file_of(1)
    data, heads = bytearray(file.read_bytes()), list(images.part_heads(pa.OSFile(str(file))))
    at, size, kind, *_ = heads[1]
    data[at : at + int(np.prod(size)) * kind.itemsize] = b"\xff" * (int(np.prod(size)) * kind.itemsize)  # NaN
    file.write_bytes(bytes(data))
    assert images.images(spark, str(tmp_path), ("pid", "c1", "label")).where("isnan(c1)").count() == 0
    assert images.images(spark, str(tmp_path), ("pid", "z")).where("isnan(z)").count() == 20


def test_partitions_are_planned_by_size(spark, tmp_path, monkeypatch):
    images.saved(spark.createDataFrame(pd.concat([image(4, 5, k) for k in range(1, 6)]), PIXELS), str(tmp_path))
    reader = images.ImageReader(spark.createDataFrame([], PIXELS).schema, str(tmp_path))
    assert [len(p.files) for p in reader.partitions()] == [5]
    monkeypatch.setattr(images, "BYTES", 2 * (tmp_path / images.file_of(1)).stat().st_size)
    assert [len(p.files) for p in reader.partitions()] == [2, 2, 1]


def test_an_image_may_come_in_parts(spark, tmp_path):
    """Three images over four files, one file a micro-batch: each is segmented once it is whole."""
    df = spark.createDataFrame(pd.concat([image(6, 6, k) for k in (1, 2, 3)]), PIXELS)
    for k, some in enumerate(("image_id = 1 AND pid < 20 OR image_id = 2 AND pid < 5", "image_id = 2", "image_id = 1 AND pid >= 20 OR image_id = 3 AND pid < 30", "image_id = 1 AND pid < 3")):
        df.where(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = GraphConfig(scale_k=0.5, min_size=3)
    segment_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), config, size=36, files=1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/labels"))
    assert {r["image_id"]: r["count"] for r in got.groupBy("image_id").count().collect()} == {1: 36, 2: 36}
    expected = segment(df.where("image_id < 3"), config)
    assert sorted(map(tuple, got.select("image_id", "pid", "label").collect())) == sorted(map(tuple, expected.collect()))

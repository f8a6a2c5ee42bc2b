"""Whole algorithms and stencils against plain versions, plug-ins, and batches."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import distributions as D
from lumigrid.model import PIXELS, GraphConfig, SpectralConfig, WatsonConfig, config_of, params
from lumigrid.operators import grid, metrics, mixture
from lumigrid.operators.segment import gaussian, landmark_pixels, landmarks, merged_graph, nystrom, segment
from lumigrid.plans import harness
from lumigrid.sources import store


def noisy(h, w, seed, image_id=1):
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[1 : h + 1, 1 : w + 1]
    n = rng.normal(size=(h * w, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    columns = {f"c{k}": rng.random(h * w) for k in (1, 2, 3)} | {"x": c.ravel() * 0.1, "y": r.ravel() * 0.1, "z": 2 + rng.random(h * w) * 0.3}
    return pd.DataFrame({"image_id": image_id, "pid": ((c - 1) * h + r).ravel(), "row": r.ravel(), "col": c.ravel(), **columns, "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "label": 1 + ((r > h // 2) * 2 + (c > w // 2)).ravel()})


@pytest.fixture(scope="module")
def image():
    return noisy(9, 11, 1)


@pytest.fixture(scope="module")
def pixels(spark, image):
    return spark.createDataFrame(image, PIXELS)


def near(image, row, col, w):
    return image[(image["row"] - row).abs().le(w) & (image["col"] - col).abs().le(w)]


def test_planes_and_svd_normals_by_pixel(pixels, image):
    planes = grid.planes(pixels, 2, 0.1).toPandas().set_index("pid")
    normals = grid.svd_normals(pixels, 2, 0.15).toPandas().set_index("pid")
    for p in image.itertuples():
        around = near(image, p.row, p.col, 2)
        like = around[(around["z"] - p.z).abs() < p.z * 0.1]
        if len(like) >= 3:
            points = np.column_stack([like[["x", "y", "z"]].to_numpy(), np.ones(len(like))])
            v = np.linalg.eigh(points.T @ points)[1][:, 0]
            v = v / np.linalg.norm(v[:3]) * (-1 if v[2] > 0 else 1)
            np.testing.assert_allclose(planes.loc[p.pid, ["nx", "ny", "nz"]].to_numpy(float), v[:3], atol=1e-6)
        like = around[(around["z"] - p.z).abs() <= 0.15]
        if len(like) > 3:
            x = like[["x", "y", "z"]].to_numpy()
            v = np.linalg.svd(x - x.mean(axis=0))[2][-1]
            v = v * (-1 if v[2] > 0 else 1)
            np.testing.assert_allclose(normals.loc[p.pid].to_numpy(float)[1:], v, atol=1e-5)


def test_filling_in_place_feeds_later_fills(spark, image):
    rng = np.random.default_rng(2)
    df = image.copy()
    df.loc[rng.random(len(df)) < 0.3, ["nx", "ny", "nz"]] = 0.0
    df.loc[[5, 40], "nx"] = np.inf
    got = grid.filled_normals_in_place(spark.createDataFrame(df, PIXELS), 1).toPandas().sort_values(["row", "col"])
    n = {(p.row, p.col): np.array([p.nx, p.ny, p.nz]) for p in df.itertuples()}
    for k in sorted(n):
        size = np.linalg.norm(n[k])
        if not size >= 1e-6 or not np.isfinite(size):
            s = sum(v for (r, c), v in n.items() if abs(r - k[0]) <= 1 and abs(c - k[1]) <= 1 and np.isfinite(v).all())
            n[k] = s / np.linalg.norm(s) if np.linalg.norm(s) else np.full(3, np.nan)
    np.testing.assert_allclose(got[["nx", "ny", "nz"]].to_numpy(), np.array([n[k] for k in sorted(n)]), atol=1e-9)


def plain_graph(n, edges, weights, k, least):
    """The graph merging with sets of pixels instead of a forest; sizes stay as they are in the second pass."""
    part = {i: frozenset([i]) for i in range(n)}
    limit = {part[i]: (k, k, k) for i in range(n)}
    size = {part[i]: 1 for i in range(n)}
    order = sorted(range(len(edges)), key=lambda e: (weights[e][0], *edges[e]))
    for small in (False, True):
        for e in order:
            a, b = (part[i] for i in edges[e])
            fits = size[a] < least or size[b] < least if small else all(w <= min(p, q) for w, p, q in zip(weights[e], limit[a], limit[b]))
            if a != b and fits:
                both = a | b
                size[both] = len(both)
                limit[both] = tuple(w + k / len(both) for w in weights[e])
                for i in both:
                    part[i] = both
    return [min(part[i]) for i in range(n)]


@pytest.mark.parametrize("k, least", [(0.5, 0), (1.5, 4), (3.0, 12)])
def test_graph_merging(k, least):
    rng = np.random.default_rng(int(k * 10))
    edges = np.array([(i, j) for i in range(30) for j in (i + 1, i + 6) if j < 30])
    weights = rng.random((len(edges), 3))
    roots = merged_graph(30, edges, weights, GraphConfig(scale_k=k, min_size=least, update_sizes=True))
    names = {r: min(np.flatnonzero(roots == r)) for r in set(roots)}
    assert [names[r] for r in roots] == plain_graph(30, edges.tolist(), weights.tolist(), k, least)


def test_nystrom_with_all_landmarks_is_exact():
    rng = np.random.default_rng(4)
    f = rng.normal(size=(40, 6)) * 0.4
    a = np.exp(-((f[:, None] - f[None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(gaussian(f, f), a, atol=1e-12)
    d = 1 / np.sqrt(a.sum(axis=1))
    values, vectors = np.linalg.eigh(a * d[:, None] * d[None])
    got = nystrom(f, np.arange(40), 3)
    for k in range(3):
        v = got[:, k] / np.linalg.norm(got[:, k])
        assert abs(abs(v @ vectors[:, -1 - k]) - 1) < 1e-5


def test_spectral_fits_a_half_size_image():
    """Rows times landmarks of a 225 by 305 image: some 750 MB, not the differences of all six channels."""
    import resource

    f = np.random.default_rng(5).normal(size=(225 * 305, 6)) * 0.2
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = nystrom(f, landmarks(len(f), 0.01), 5)
    assert out.shape == (len(f), 5) and np.isfinite(out).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_500_000


@pytest.mark.parametrize("proportion", [0.01, 0.1, 0.33, 1.0])
def test_landmark_plan_equals_the_kernel(pixels, image, proportion):
    got = sorted(r["pid"] for r in landmark_pixels(pixels, proportion).select("pid").collect())
    assert got == (landmarks(len(image), proportion) + 1).tolist()


def test_watson_mixture_separates_axes():
    rng = np.random.default_rng(6)
    axes = np.eye(3)[rng.integers(0, 3, 300)]
    x = axes * rng.choice([-1, 1], 300)[:, None] + rng.normal(size=(300, 3)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = mixture.watson_mixture(x, WatsonConfig(k=3, k_init=6, iterations=40))
    assert all(len(set(axes[labels == k].argmax(axis=1))) == 1 for k in set(labels)) and len(set(labels)) == 3


def test_edge_weights_and_affinity_and_rules_can_be_given(spark, pixels):
    def one_weight(df):
        return grid.edges(df, ["label"]).select("image_id", "src", "dst", *[F.when(F.col("label") == F.col("o_label"), 0.0).otherwise(9.0).alias(w) for w in ("w_rgb", "w_xyz", "w_n")])

    found = segment(pixels, GraphConfig(scale_k=1.0, min_size=0, weigh=one_weight)).join(pixels.select("image_id", "pid", F.col("label").alias("truth")), ["image_id", "pid"])
    assert found.select("label", "truth").distinct().count() == 4 == found.select("label").distinct().count()
    seen = []

    def affinity(x, y):
        seen.append(1)
        return gaussian(x[:, :3], y[:, :3])

    f = np.random.default_rng(1).normal(size=(50, 6))
    nystrom(f, np.arange(0, 50, 5), 2, affinity)
    assert seen
    kept = segment(pixels, SpectralConfig(lambdas=(0.1,), k=3, proportion=0.3, return_pruned=True, delete=lambda n: False))
    gone = segment(pixels, SpectralConfig(lambdas=(0.1,), k=3, proportion=0.3, return_pruned=True, delete=lambda n: n < 30))
    assert kept.select("label").distinct().count() > gone.select("label").distinct().count()


def test_boundary_distance_has_no_bound(spark):
    df = noisy(12, 60, 3)
    a = spark.createDataFrame(df.assign(label=1 + (df["col"] > 3)), PIXELS)
    b = spark.createDataFrame(df.assign(label=1 + (df["col"] > 50)), PIXELS)
    assert metrics.boundary_displacement(a, b).first()["value"] == pytest.approx(46.5)
    rng = np.random.default_rng(2)
    one = noisy(70, 17, 4)
    here, there = one[rng.random(len(one)) < 0.1], one[rng.random(len(one)) < 0.02]
    got = {r["pid"]: r["distance"] for r in metrics.nearest_boundary(spark.createDataFrame(here, PIXELS), spark.createDataFrame(there, PIXELS)).collect()}
    at = there[["row", "col"]].to_numpy()
    assert got == pytest.approx({p.pid: np.sqrt(((at - (p.row, p.col)) ** 2).sum(axis=1)).min() for p in here.itertuples()})


def test_kummer_at_large_arguments_and_poles():
    assert D.kummer(1.5, 1.5, 600) == pytest.approx(np.exp(600))
    assert D.kummer(2.5, 1.5, 650) == pytest.approx((1 + 650 / 1.5) * np.exp(650), rel=1e-9)
    assert D.kummer(0.5, 0.0, 1.0) == D.kummer(0.5, -2.0, 1.0) == np.inf


def test_parameters_there_and_back():
    for record in (GraphConfig(scale_k=3.5, update_sizes=True), SpectralConfig(lambdas=(0.5,), lab_mode="standard"), WatsonConfig(k=9)):
        assert config_of(type(record), params(record)) == record


def test_batches(spark, tmp_path):
    df = spark.createDataFrame(pd.concat([noisy(6, 6, 1, 1), noisy(6, 6, 2, 2)]), PIXELS)
    kept = store.Store(spark, str(tmp_path))
    config = {"algorithms": {"CDNGraph": {"scale_k": 2.0, "min_size": 3}, "Diametrical": {"k": 2}}}
    first = harness.segment_batch(df, config, kept).collect()
    assert sorted((r["image_id"], r["algorithm"], r["error"]) for r in first) == [(i, a, None) for i in (1, 2) for a in ("CDNGraph", "Diametrical")]
    again = harness.segment_batch(df, config, kept).collect()
    assert sorted(r["elapsed"] for r in again) == sorted(r["elapsed"] for r in first)
    with pytest.raises(LookupError):
        harness.evaluate_batch(df, {**config, "scale": 0.5}, kept)
    n = harness.evaluate_batch(df, config, kept).count()
    assert n == 4 * (len(metrics.SUPERVISED) + len(metrics.BOUNDARY) + len(metrics.UNSUPERVISED))
    assert harness.evaluate_batch(df, config, kept).count() == n
    assert harness.summarize(kept).count() == n // 2
    number = harness.store_id("CDNGraph", GraphConfig(scale_k=2.0, min_size=3))
    expected = segment(df, GraphConfig(scale_k=2.0, min_size=3)).toPandas().sort_values(["image_id", "pid"])
    assert kept.labels(number).toPandas().sort_values(["image_id", "pid"])["label"].tolist() == expected["label"].tolist()
    other = {"algorithms": {"CDNGraph": {"scale_k": 2.0, "min_size": 36}}}
    assert harness.segment_batch(df, other, kept).count() == 6
    assert harness.evaluate_batch(df, other, kept).count() > n
    assert harness.summarize(kept, other).select("algorithm_id").distinct().count() == 1
    half = harness.segment_batch(df, {**config, "scale": 0.5}, kept)
    assert half.count() == 10 and len({r["algorithm_id"] for r in half.collect()}) == 5
    with pytest.raises(KeyError):
        harness.segment_batch(df, {"algorithms": {"Unknown": {}}}, kept)


def test_boundary_pixels_are_found_once_for_all_metrics(spark, monkeypatch):
    """A batch finds the boundary pixels of either labelling once, with the values of each metric on its own."""
    df = spark.createDataFrame(pd.concat([noisy(40, 37, 1, 1), noisy(9, 50, 2, 2)]), PIXELS)
    seg = df.select("image_id", "pid", "row", "col", (1 + (F.col("row") > 17).cast("int") + F.when(F.col("col") > 33, 2).otherwise(0)).alias("label"))
    value = lambda rows: sorted((r["image_id"], round(r["value"], 9)) for r in rows.collect())
    alone = {k: value(f(seg, df)) for k, f in metrics.BOUNDARY.items()}
    found, edges = [], metrics.edge_pixels
    monkeypatch.setattr(metrics, "edge_pixels", lambda x: found.append(x) or edges(x))
    rows = metrics.supervised(seg, df, "").cache()
    assert {k: value(rows.where(F.col("metric") == k)) for k in alone} == alone and len(found) == 2
    rims = [edges(x).toPandas() for x in (seg, df)]
    for image, displacement in alone["BoundaryDisplacementError"]:
        a, b = (x[x["image_id"] == image][["row", "col"]].to_numpy() for x in rims)
        far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        assert abs(displacement - (far.min(axis=1).mean() + far.min(axis=0).mean()) / 2) < 1e-9


def test_an_image_that_fails_costs_no_other(spark, tmp_path):
    df = spark.createDataFrame(pd.concat([noisy(6, 6, 1, 1), noisy(6, 6, 2, 2).assign(nx=np.nan)]), PIXELS)
    kept, config = store.Store(spark, str(tmp_path)), {"algorithms": {"Diametrical": {"k": 2}, "CDNGraph": {"min_size": 3}}}
    rows = {(r["image_id"], r["algorithm"]): r for r in harness.segment_batch(df, config, kept).collect()}
    assert {k for k, r in rows.items() if r["error"]} == {(2, "Diametrical")} and rows[2, "Diametrical"]["elapsed"] is None
    assert all(r["elapsed"] > 0 for k, r in rows.items() if k != (2, "Diametrical"))
    mended = spark.createDataFrame(pd.concat([noisy(6, 6, 1, 1), noisy(6, 6, 2, 2)]), PIXELS)
    rows = {(r["image_id"], r["algorithm"]): r for r in harness.segment_batch(mended, config, kept).collect()}
    assert len(rows) == 4 and not any(r["error"] for r in rows.values())


def test_plug_ins_have_numbers_of_their_own():
    a, b = (SpectralConfig(delete=f) for f in (lambda n: n < 3, lambda n: n < 30))
    assert len({harness.store_id("GCF", r, s) for r in (a, b, SpectralConfig()) for s in (1, 0.5)}) == 6


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(noisy(6, 6, 1), PIXELS).write.parquet(str(tmp_path / "pixels"))
    config = {"algorithms": {"CDNGraph": {"scale_k": 2.0, "min_size": 3}}, "pixels": str(tmp_path / "pixels"), "store": str(tmp_path / "store")}
    (tmp_path / "config.json").write_text(json.dumps(config))
    for step in ("segment", "evaluate", "summarize"):
        harness.main([step, "--config", str(tmp_path / "config.json")])
    assert "RandIndex" in capsys.readouterr().out


def test_an_update_that_breaks_off_leaves_the_table(spark, tmp_path):
    kept, schema = store.Store(spark, str(tmp_path)), "k long, v long"
    kept.insert("t", schema, spark.createDataFrame([(1, 1), (2, 2)], schema), ["k"])
    bad = spark.createDataFrame([(1, 5)], schema).withColumn("v", F.expr("assert_true(k > 1)").cast("long"))
    with pytest.raises(Exception, match="k > 1"):
        kept.update("t", schema, bad, ["k"])
    assert sorted(map(tuple, kept.read("t", schema).collect())) == [(1, 1), (2, 2)]
    before = kept.read("t", schema)
    kept.update("t", schema, spark.createDataFrame([(1, 5), (3, 3)], schema), ["k"])
    assert sorted(map(tuple, kept.read("t", schema).collect())) == [(1, 5), (2, 2), (3, 3)] and before.count() == 2
    kept.insert("t", schema, spark.createDataFrame([(3, 9), (4, 4)], schema), ["k"])
    assert sorted(map(tuple, kept.read("t", schema).collect())) == [(1, 5), (2, 2), (3, 3), (4, 4)]

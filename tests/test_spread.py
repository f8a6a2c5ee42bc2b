"""Tiles, blocks and turns: what is taken apart equals what one task makes of a whole image."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumigrid.model import CHANNELS, NORMAL, PIXELS, DiametricalConfig, GraphConfig, MixtureConfig, SpectralConfig, WatsonConfig
from lumigrid.operators import grid, iterated, merging, metrics, mixture, regions, spectral, tiles
from lumigrid.operators.segment import merged_graph, segment
from test_algorithms import noisy


@pytest.fixture(scope="module")
def images():
    holes = noisy(11, 8, 7, 3)
    return pd.concat([noisy(13, 17, 1, 1), noisy(9, 20, 5, 2), holes[holes["pid"] % 6 != 0]])


@pytest.fixture(scope="module")
def pixels(spark, images):
    return spark.createDataFrame(images, PIXELS).cache()


def test_neighbours_are_those_of_a_join(pixels, images):
    for offsets in (grid.HALF, grid.window(2)):
        got = tiles.neighbours(pixels, list(offsets), ["z", "label"], side=4)
        found = {(r["image_id"], r["pid"], r["dr"], r["dc"]): (r["n_pid"], r["row"], r["col"], r["z"], r["o_z"], r["label"], r["o_label"]) for r in got.collect()}
        at = {(p.image_id, p.row, p.col): p for p in images.itertuples()}
        expected = {(p.image_id, p.pid, dr, dc): (q.pid, q.row, q.col, q.z, p.z, q.label, p.label) for p in images.itertuples() for dr, dc in offsets if (q := at.get((p.image_id, p.row + dr, p.col + dc)))}
        assert found == expected


def test_rows_shuffled_are_few(spark):
    """A window of 11 by 11 shuffles less than 1.5 rows for each pixel, not 121."""
    df = spark.createDataFrame(noisy(256, 256, 2), PIXELS)
    assert tiles.dealt(df, ["z"], 5).count() < 1.5 * 256 * 256
    assert tiles.dealt(df, ["z"], 3).where("own").count() == 256 * 256


def test_results_do_not_depend_on_tiles(pixels, monkeypatch):
    def every():
        cleaned = grid.cleaned_normals(pixels.withColumn("nx", F.when(F.col("pid") % 5 == 0, float("nan")).otherwise(F.col("nx"))), 2)
        frames = {"moments": grid.moments(pixels, 2, 0.1), "median": grid.median3x3(pixels), "rims": grid.boundaries(pixels, 2), "edges": metrics.edge_pixels(pixels), "weights": grid.weights(pixels), "cleaned": cleaned}
        frames["zeboudj"] = metrics.zeboudj(pixels, 3, ("c1", "z"))
        return {k: f.toPandas().sort_values([c for c in ("image_id", "pid", "src", "dst", "label") if c in f.columns]).reset_index(drop=True) for k, f in frames.items()}

    whole = every()
    monkeypatch.setattr(tiles.dealt, "__defaults__", (4,))
    for name in ("by_tile", "stencil", "neighbours"):
        f = getattr(tiles, name)
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 4))
    for k, small in every().items():
        pd.testing.assert_frame_equal(small[sorted(small.columns)], whole[k][sorted(whole[k].columns)], check_exact=False, rtol=1e-9)


def test_separable_box(images):
    one = images[images["image_id"] == 3]
    t = tiles.Tile.whole(one, ["z"], 2)
    at = {(p.row, p.col): p.z for p in one.itertuples()}
    expected = [sum(at.get((p.row + dr, p.col + dc), 0.0) for dr, dc in grid.window(2)) for p in one.itertuples()]
    np.testing.assert_allclose(t.of(t.box(t.grid("z"), 2)), expected)


def test_flat_images_have_no_gradient(spark):
    df = spark.createDataFrame(noisy(5, 5, 1).assign(c1=0.5), PIXELS)
    assert grid.sobel(df, ["c1"]).where("mog <> 0").count() == 0


def labels_of(df):
    return df.toPandas().sort_values(["image_id", "pid"])["label"].to_numpy()


def by_image(images, f):
    return np.concatenate([f(rows.sort_values("pid")) for _, rows in images.groupby("image_id")])


@pytest.fixture(scope="module")
def whole(images):
    return images[images["image_id"] < 3]


@pytest.mark.parametrize("config, side", [(GraphConfig(scale_k=2.0, min_size=4), 3), (GraphConfig(scale_k=1.5, min_size=12, update_sizes=True), 5), (GraphConfig(scale_k=3.0, min_size=30), 4)])
def test_graph_merging_by_tiles(pixels, config, side):
    df = pixels.where("image_id < 3")
    assert (labels_of(segment(df, config, side)) == labels_of(segment(df, config))).all()


@pytest.mark.parametrize("seed", range(12))
def test_put_off_edges_keep_the_sequence(seed):
    """Random graphs: parts take their edges, what they put off is taken after them, and all is as in one sequence."""
    r = np.random.default_rng(seed)
    n, k, least = 40, float(r.choice([0.3, 0.8, 2.0])), int(r.integers(0, 8))
    edges = np.unique(np.sort(r.integers(0, n, (90, 2)), axis=1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    weights = r.integers(0, 6, (len(edges), 3)) / 5
    config = GraphConfig(scale_k=k, min_size=least, update_sizes=bool(seed % 2))
    part = r.integers(0, 4, n)
    order = np.lexsort((edges[:, 1], edges[:, 0], weights[:, 0]))
    rank, size, limits, up = [0] * n, [1] * n, [(k, k, k)] * n, np.arange(n)
    for small in (False, True):
        todo = [(int(a), int(b), tuple(weights[e])) for e in order for a, b in [up[edges[e]]]]
        for parts in (part, part // 2, part * 0):
            one = merging.Sequence(rank, size, limits, config, small)
            left = []
            for a, b, w in todo:
                if parts[a] != parts[b]:
                    one.leaves(a)
                    one.leaves(b)
                    left.append((a, b, w))
                elif one.meets(a, b, w):
                    left.append((a, b, w))
            roots = np.array([one.root(i) for i in range(n)])
            rank, size, limits = one.rank, one.size, one.limits
            todo = [(int(roots[a]), int(roots[b]), w) for a, b, w in left]
            up = roots[up]
    expected = merged_graph(n, edges, weights, config)
    assert len({(a, b) for a, b in zip(up, expected)}) == len(set(up)) == len(set(expected))


def test_mixtures_turn_by_turn(pixels, whole):
    df = pixels.where("image_id < 3")
    config = MixtureConfig(k=3, max_iterations=18)
    got = labels_of(iterated.joint_em(df, config, block=30))
    assert (got == by_image(whole, lambda x: mixture.joint_em(x[list(CHANNELS)].to_numpy(), config).argmax(axis=1) + 1)).all()


def test_mixture_from_given_labels(pixels, whole):
    df, config = pixels.where("image_id < 3"), MixtureConfig(max_iterations=16)
    start = df.select("image_id", "pid", (F.col("pid") % 3).cast("int").alias("label"))
    got = labels_of(iterated.joint_em(df, config, start, block=50))
    plain = lambda x: mixture.joint_em(x[list(CHANNELS)].to_numpy(), config, (x["pid"] % 3).to_numpy()).argmax(axis=1) + 1
    assert (got == by_image(whole, plain)).all()


def test_directions_turn_by_turn(pixels, whole):
    df = pixels.where("image_id < 3")
    config = WatsonConfig(k=2, k_init=4, iterations=6)
    got = labels_of(iterated.watson_mixture(df, config, 40))
    assert (got == by_image(whole, lambda x: mixture.watson_mixture(x[list(NORMAL)].to_numpy(), config) + 1)).all()
    config = DiametricalConfig(k=3)
    got = labels_of(segment(df, config, 6))
    assert (got == labels_of(segment(df, config))).all()


def test_images_that_converge_leave(pixels):
    """Each image stops by itself."""
    blocks = iterated.packed(pixels, NORMAL, 40)
    state = iterated.diametrical(blocks, DiametricalConfig(k=2, max_iterations=50)).collect()
    assert len(state) == 3 and all(r["done"] for r in state) and len({r["turn"] for r in state}) > 1


def test_spectral_by_blocks(pixels):
    df, config = pixels.where("image_id = 1"), SpectralConfig(lambdas=(0.3,), k=3, nev=3, proportion=0.1, prune_below=4)
    assert (labels_of(segment(df, config, 6)) == labels_of(segment(df, config))).all()


def test_nystrom_holds_blocks_only(monkeypatch):
    f = np.random.default_rng(5).normal(size=(900, 6)) * 0.3
    at = spectral.landmarks(900, 0.1)
    whole = spectral.nystrom(f, at, 4)
    most = []
    monkeypatch.setattr(spectral, "CELLS", 1000)
    spectral.nystrom(f, at, 4, lambda x, y: most.append(len(x)) or spectral.gaussian(x, y))
    assert max(most) <= len(at)
    np.testing.assert_allclose(np.abs(spectral.nystrom(f, at, 4)), np.abs(whole), atol=1e-9)


def test_nystrom_at_full_size_fits_a_gigabyte():
    """451 x 611 pixels at a hundredth of landmarks; the whole affinity would take 6 GB, twice."""
    import subprocess
    import sys

    code = "import resource, numpy as np; from lumigrid.operators import spectral as s; f = np.random.default_rng(1).normal(size=(451 * 611, 6)) * .3; b = resource.getrusage(0).ru_maxrss; x = s.nystrom(f, s.landmarks(len(f), .01), 5); assert x.shape == (len(f), 5) and np.isfinite(x).all(); print(resource.getrusage(0).ru_maxrss - b)"
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1])).stdout)
    assert used < 1_000_000


def test_landmarks_of_low_rank_equal_the_whole(monkeypatch):
    """The factor of the landmarks' affinities gives the eigenvectors of all of them, up to sign; full ranks take all of them."""
    r = np.random.default_rng(8)
    halves = np.concatenate([r.normal(size=(900, 6)) * 0.002 + at for at in (0.5, 2.5)])
    for f, low in ((halves, True), (np.ones((500, 6)), True), (r.normal(size=(900, 6)), False)):
        at = spectral.landmarks(len(f), 0.3)
        monkeypatch.setattr(spectral, "DENSE", 1 << 20)
        whole = spectral.nystrom(f, at, 2 if low else 4)
        monkeypatch.setattr(spectral, "DENSE", 1)
        assert (spectral.factor(f[at]) is not None) == low
        got = spectral.nystrom(f, at, whole.shape[1])
        some = slice(None) if len(np.unique(f)) > 1 else slice(1)  # equal rows have one direction
        np.testing.assert_allclose(np.abs(got[:, some]), np.abs(whole[:, some]), atol=1e-6)


def test_many_landmarks_fit_a_task():
    """12,000 landmarks: their affinities to each other would take 1.2 GB, several times."""
    import subprocess
    import sys

    code = "import resource, numpy as np; from lumigrid.operators import spectral as s; r = np.random.default_rng(1); f = np.concatenate([r.normal(size=(6000, 6)) * 5e-4 + a for a in (.5, 2.5)]); b = resource.getrusage(0).ru_maxrss; x = s.nystrom(f, np.arange(len(f)), 2); assert x.shape == (len(f), 2) and np.isfinite(x).all(); print(resource.getrusage(0).ru_maxrss - b)"
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1])).stdout)
    assert used < 400_000


def test_blocks_grow_with_the_landmarks_that_they_meet(pixels, monkeypatch):
    """Each block is sent its image's landmarks: with 160 of them a block has 20 pixels, not 4."""
    sizes, pack = [], iterated.packed
    monkeypatch.setattr(iterated, "packed", lambda df, names, size: sizes.append(size) or pack(df, names, size))
    df, config = pixels.where("image_id = 1"), SpectralConfig(lambdas=(0.3,), k=3, nev=3, proportion=0.4, prune_below=4)
    n = round(df.count() * 0.4)
    assert (labels_of(segment(df, config, 2)) == labels_of(segment(df, config))).all() and sizes == [max(4, n // 8)] and n > 32


def test_disparity_of_many_regions(spark, monkeypatch):
    """20,000 regions: sums of distances by blocks."""
    r = np.random.default_rng(3)
    x = r.normal(size=(20_000, 3))
    some = r.choice(20_000, 20)
    got = metrics.distance_sums(x[some], x)
    np.testing.assert_allclose(got, [np.sqrt(((x - x[i]) ** 2).sum(axis=1)).sum() for i in some])
    df = spark.createDataFrame(noisy(20, 20, 4).assign(label=np.arange(400) // 2), PIXELS)
    whole = metrics.frc_rgbd(df).first()["value"]
    monkeypatch.setattr(metrics, "REGIONS", 16)
    assert metrics.frc_rgbd(df).first()["value"] == pytest.approx(whole)


def test_components_of_edges(spark):
    r = np.random.default_rng(6)
    edges = r.integers(0, 80, (60, 2))
    up = list(range(80))
    for a, b in edges.tolist():
        x, y = up[a], up[b]
        up = [min(x, y) if u in (x, y) else u for u in up]
    nodes = spark.createDataFrame([(1, i) for i in range(80)], "image_id long, pid long")
    got = regions.linked(nodes, spark.createDataFrame([(1, a, b) for a, b in edges.tolist()], "image_id long, src long, dst long"))
    assert {x["pid"]: x["root"] for x in got.collect()} == dict(enumerate(up))

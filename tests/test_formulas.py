"""Golden values and invariants of the distributions and kernels."""

import numpy as np
import pytest

from lumigrid.functions import distributions as D
from lumigrid.model import GraphConfig, SpectralConfig, params
from lumigrid.operators import mixture, regions, segment
from lumigrid.sources import dataset, store


def test_watson_statistic():
    np.testing.assert_allclose(D.watson_statistic(np.array([3.0, 1, 5]))[0], [9, 1, 25, 4.24264, 21.2132, 7.07107], atol=1e-4)


def test_kummer():
    assert D.kummer(0.5, 1.5, 0.5) == pytest.approx(1.19496, abs=1e-3)
    assert D.kummer_ratio(0.5, 1.5, 0.5) == pytest.approx(0.37973, abs=1e-3)
    for x in (29.0, 31.0, 33.0, 60.0):
        assert D.log_kummer(0.5, 1.5, x) == pytest.approx(np.log(D._series(0.5, 1.5, x)), rel=1e-7)
    assert np.isfinite(D.log_kummer(0.5, 1.5, 5000.0))


@pytest.mark.parametrize("r", (np.linalg.norm([0.01, 0.05, 0.2]), 0.5774, 0.7, 0.9))
def test_concentration_round_trip(r):
    assert D.kummer_ratio(0.5, 1.5, D.concentration(3, r)) == pytest.approx(r, abs=1e-5)


def test_concentration_below_a_third_is_negative():
    assert D.concentration(3, 0.206398) == pytest.approx(-1.756468, abs=1e-3)


def test_gaussian_equals_log_density():
    x = np.array([[1.0, 2, 2, 3, 4], [0, 0, 1, 1, 5], [1, 1, 2, 2, 1]]).T
    g = D.Gaussian.of(x)
    s = np.cov(x.T)
    d = x - x.mean(axis=0)
    expected = -0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d) + np.log(np.linalg.det(s)) + 3 * np.log(2 * np.pi))
    np.testing.assert_allclose(g.logpdf(x), expected, atol=1e-8)


def test_watson_axis_and_divergence():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) * [0.1, 0.1, 1]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = D.Watson(D.watson_statistic(x).mean(axis=0))
    assert abs(w.axis()[2]) > 0.99
    assert w.divergence(w) == pytest.approx(0, abs=1e-9)
    axis, kappa = D.watson_mle(x)
    assert abs(axis[2]) > 0.99 and kappa > 5


def test_graph_contraction():
    g = regions.Graph()
    for v in range(1, 9):
        g.add(name=v)
    for a, b in ((1, 2), (1, 3), (2, 3), (1, 4), (1, 5), (1, 8), (4, 6), (5, 7)):
        g.connect(a, b)
    assert g.contract(4, 3) == 9
    assert {v: g.adjacent(v) for v in g.vertices()} == {1: [2, 5, 8, 9], 2: [1, 9], 9: [1, 2, 6], 5: [1, 7], 8: [1], 7: [5], 6: [9]}


def test_proportion_is_checked():
    with pytest.raises(ValueError, match="Invalid Proportion"):
        SpectralConfig(proportion=1.5)
    assert params(GraphConfig())["min_size"] == "200"


def test_unknown_algorithm(spark):
    with pytest.raises(NotImplementedError):
        segment.segment(spark.range(1), object())


def test_merging_splits_a_step():
    pairs = np.array([[0, 1], [1, 2], [2, 3]])
    weights = np.array([[0.0, 0, 0], [5.0, 5, 5], [0.0, 0, 0]])
    roots = segment.merged_graph(4, pairs, weights, GraphConfig(scale_k=1.0, min_size=0))
    assert roots[0] == roots[1] != roots[2] == roots[3]
    assert len(set(segment.merged_graph(4, pairs, weights, GraphConfig(scale_k=1.0, min_size=3)))) == 1


def test_components_of_a_checkerboard():
    import pandas as pd

    image = pd.DataFrame([(r, c, (r + c) % 2) for c in range(1, 5) for r in range(1, 5)], columns=["row", "col", "label"])
    assert len(set(regions.flooded(*regions.as_grid(image, "label")))) == 16


def test_average_linkage():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0.0]])
    g = mixture.average_linkage(d, 2)
    assert g[0] == g[1] != g[2] == g[3]


def test_fits_round_trip_and_png():
    parts = [np.arange(24, dtype=np.uint8).reshape(3, 2, 4), np.linspace(0, 1, 24).reshape(3, 2, 4), np.arange(8, dtype=np.int32).reshape(2, 4)]
    for a, b in zip(dataset.fits_parts(dataset.fits_bytes(parts)), parts):
        np.testing.assert_array_equal(a, b)
    assert dataset.png_bytes(np.zeros((2, 3, 3), np.uint8)).startswith(b"\x89PNG")


def test_ddl_of_a_record():
    class Algorithm:
        id: int
        name: str
        params: dict

    assert store.create_table_sql(Algorithm) == "CREATE TABLE IF NOT EXISTS algorithm (id BIGINT, name STRING, params STRING) USING parquet"

"""Each query of the scene engine against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumigrid.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else repr(round(float(x), 9)) if isinstance(x, (float, np.floating)) else str(x) for x in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, tables, name):
    got, expected = plain(QUERIES[name](spark, SF).toPandas()), plain(tables.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(got, expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    if set(df.columns) == {"image_id", "pid", "label"}:
        for _, image in df.toPandas().groupby("image_id"):
            assert sorted(image["label"].unique()) == list(range(1, image["label"].nunique() + 1))


def test_all_edges_are_ranked(spark):
    ranked = QUERIES["edges_by_rgb"](spark, SF).toPandas()
    assert len(ranked) == QUERIES["edge_weights"](spark, SF).count() > 50
    for _, image in ranked.groupby("image_id"):
        image = image.sort_values("rank")
        assert image["rank"].tolist() == list(range(1, len(image) + 1)) and image["w_rgb"].is_monotonic_increasing

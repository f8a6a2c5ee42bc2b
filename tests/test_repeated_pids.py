"""Images that their last row does not fill: some pixels share a pid, and some places have no pixel.

A table of rows that no 20 divides gives one image whose last row is short and has pids that other pixels have already;
a table that no 100 divides gives a last image that lacks pixels.
"""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import regions
from lumigrid.operators.segment import landmark_pixels
from lumigrid.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
ROWS = 256


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else repr(round(float(x), 9) + 0.0) if isinstance(x, (float, np.floating)) else str(x) for x in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Embeddings of 256 rows: 12 full rows of 20 pixels and 16 pixels more; two images of 100 pixels and one of 56."""
    where = tmp_path_factory.mktemp("odd")
    tables = duckdb.connect()
    tables.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < {ROWS}) TO '{where}/embeddings.parquet'")
    tables.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    return str(where), tables


def same(spark, odd, name: str) -> None:
    where, tables = odd
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, where).toPandas()), plain(tables.execute(SQL[name]).df()))


def test_gradients(spark, odd):
    same(spark, odd, "sobel_magnitude")
    same(spark, odd, "boundary_strength")


@pytest.mark.parametrize("name", ["element_subtract", "element_zero", "fill_normals", "clean_normals", "local_planes_plane", "svd_normals_plane", "local_moments", "svd_normals", "median3x3", "connected_components_relational"])
def test_equals_its_sql(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", ["fits_round_trip", "image_files"])
def test_files_of_images_that_lack_pixels(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", ["cdngraph_spread", "gcf_spread"])
def test_spread_equals_its_sql(spark, odd, name):
    same(spark, odd, name)


def test_a_chain_of_pids_takes_few_rounds(spark, monkeypatch):
    """A chain of 600 ascending pids: 300 rounds when each went to its least neighbour's least one."""
    calls, write = [], regions.written
    monkeypatch.setattr(regions, "written", lambda df: calls.append(1) or write(df))
    nodes = spark.range(1, 601).selectExpr("0L AS image_id", "id AS pid")
    edges = spark.range(1, 600).selectExpr("0L AS image_id", "id AS src", "id + 1 AS dst")
    got = regions.linked(nodes, edges).toPandas()
    assert len(got) == 600 and (got["root"] == 1).all()
    assert len(calls) < 4 * 25


def test_landmarks_of_one_pid_go_by_row(spark):
    """Two rows of each pid: which of them is a landmark does not depend on how the rows come."""
    rows = [(0, k, r, k, float(r)) for k in range(1, 21) for r in (1, 2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "image_id long, pid long, row int, col int, z double")
        marks = landmark_pixels(df, 0.25).toPandas()
        assert sorted(zip(marks["pid"], marks["row"])) == [(1 + 2 * k, 1) for k in range(10)]


def test_affinities_of_one_image_are_dealt_out(spark, odd):
    """One image is one key, but its rows come from several tasks, broadcast by size or not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = QUERIES["affinity"](spark, odd[0]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)

"""One image of 1,600 rows, where queries over made-up images must still equal their SQL."""

import duckdb
import pandas as pd
import pytest

from lumigrid.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    """Embeddings of sf0.1 sixteen times over: 32,000 pixels."""
    where = tmp_path_factory.mktemp("tall")
    tables = duckdb.connect()
    tables.execute(f"COPY (SELECT vec_id + k * 2000 AS vec_id, embedding, label FROM '/root/testdata/sf0.1/embeddings.parquet', range(16) AS t(k)) TO '{where}/embeddings.parquet'")
    tables.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    return str(where), tables


@pytest.mark.parametrize("name", ["cdngraph_spread", "local_planes_plane"])
def test_equals_its_sql(spark, tall, name):
    where, tables = tall
    got, expected = QUERIES[name](spark, where).toPandas(), tables.execute(SQL[name]).df()
    by = ["image_id", "pid"]
    pd.testing.assert_frame_equal(*(x[expected.columns].sort_values(by).reset_index(drop=True) for x in (got, expected)))

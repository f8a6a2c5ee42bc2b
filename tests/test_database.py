"""The result store over JDBC, against the embedded database that Spark brings along."""

import uuid
from dataclasses import make_dataclass

import pytest
from pyspark.sql import functions as F

from lumigrid.sources.database import Database

ROWS = [(1, "A", None, 1.5), (2, "A", "x", 2.5), (3, "B", None, None)]
SCHEMA = "image int, algorithm string, note string, value double"
KIND = make_dataclass("Measured", [("id", int), ("image", int), ("algorithm", str), ("note", str), ("value", float), ("params", dict)])


@pytest.fixture(scope="module")
def database(spark):
    return Database(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver")


@pytest.fixture
def table(database):
    name = database.create(KIND)
    assert database.create(KIND) == name == "measured"
    database.execute(f"DELETE FROM {name}")
    return name


def rows(spark, given=ROWS):
    return spark.createDataFrame(given, SCHEMA).withColumn("params", F.create_map(F.lit("k"), F.col("image").cast("string")))


def held(database, table):
    return sorted(((r["image"], r["algorithm"], r["note"], r["value"], r["params"]) for r in database.read(table).collect()), key=str)


def test_inserting_twice_does_nothing(spark, database, table):
    for _ in range(2):
        database.insert(table, rows(spark), ["image", "algorithm", "note"])
    assert held(database, table) == sorted(((*r, f'{{"k":"{r[0]}"}}') for r in ROWS), key=str)
    assert database.read(table, 2).rdd.getNumPartitions() == 2 and len({r["id"] for r in database.read(table).collect()}) == 3


def test_update_by_key(spark, database, table):
    database.insert(table, rows(spark), ["image"])
    database.update(table, rows(spark, [(1, "A", None, 9.0), (7, "C", "new", 7.0)]), ["image", "note"])
    assert [(r[0], r[3]) for r in held(database, table)] == [(1, 9.0), (2, 2.5), (3, None), (7, 7.0)]


def test_an_update_that_fails_changes_nothing(spark, database, table):
    database.insert(table, rows(spark), ["image"])
    before = held(database, table)
    bad = rows(spark, [(1, "A", None, 9.0)]).withColumn("unknown", F.lit(1))
    with pytest.raises(Exception, match="(?i)unknown"):
        database.update(table, bad, ["image"])
    broken = rows(spark).withColumn("value", F.expr("assert_true(image > 2)").cast("double"))
    with pytest.raises(Exception, match="image > 2"):
        database.update(table, broken, ["image"])
    assert held(database, table) == before and database.has(table)


def test_lookup(spark, database, table):
    database.insert(table, rows(spark), ["image"])
    assert database.get(table, algorithm="A", note=None)["image"] == 1
    with pytest.raises(LookupError):
        database.get(table, algorithm="Z")
    one = database.get_or_insert(table, image=5, algorithm="N", note=None)
    assert database.get_or_insert(table, image=5, algorithm="N", note=None)["id"] == one["id"] and len(held(database, table)) == 4


def test_conditions_reach_the_database(spark, database, table):
    database.insert(table, rows(spark), ["image"])
    plan = database.read(table).where("algorithm = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(ALGORITHM,A)" in plan

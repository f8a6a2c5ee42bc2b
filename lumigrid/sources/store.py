"""Result store as Parquet tables: algorithms, segmented images and metric rows.

Rows get their id from a hash of their key, so inserting twice is harmless.  An
update writes the whole table anew, as a version; tables here have a row per image and algorithm.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHM = "id BIGINT, name STRING, params MAP<STRING,STRING>"
SEGMENTED = "id BIGINT, dataset STRING, image INT, file_path STRING, algorithm_id BIGINT, metrics MAP<STRING,DOUBLE>"
RESULT = "id BIGINT, s BIGINT, results MAP<STRING,DOUBLE>"
#: Images whose labels lie in one folder, and the tasks that write it: a file for each image would make the time of saving.
IMAGES, WRITERS = 1000, 8
_TYPES = {str: "STRING", int: "BIGINT", float: "DOUBLE", bool: "BOOLEAN", dict: "STRING"}


def table_name(kind: type) -> str:
    return kind.__name__.lower()


def create_table_sql(kind: type) -> str:
    """DDL from a record type's fields; maps are kept as JSON text."""
    fields = ", ".join(f"{n} {_TYPES.get(t, 'STRING')}" for n, t in get_type_hints(kind).items())
    return f"CREATE TABLE IF NOT EXISTS {table_name(kind)} ({fields}) USING parquet"


def file_name(dataset: str, image: int, suffix: str = "seg") -> str:
    return f"{dataset}_{image}_{suffix}"


def with_id(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with an id hashed from the named columns (maps as JSON with sorted keys)."""
    maps = {f.name for f in rows.schema if isinstance(f.dataType, T.MapType)}
    part = lambda k: encoded(k) if k in maps else F.col(k).cast("string")
    return rows.withColumn("id", F.xxhash64(*[part(k) for k in keys]))


def lookup(table: DataFrame, **values: object) -> DataFrame:
    """Rows equal in all named fields; null matches null."""
    for k, v in values.items():
        table = table.where(F.col(k).eqNullSafe(F.lit(v)))
    return table


def with_algorithm(rows: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Rows that name their algorithm by ``algorithm_id`` with its name and parameters; rows of unknown ones go."""
    return rows.join(algorithms.select(F.col("id").alias("algorithm_id"), "name", "params"), "algorithm_id")


def get(table: DataFrame, **values: object):
    found = lookup(table, **values).limit(1).collect()
    if not found:
        raise LookupError(f"no row with {values}")
    return found[0]


def exists(table: DataFrame, **values: object) -> bool:
    return lookup(table, **values).limit(1).count() > 0


def missing(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the table lacks: work still to do."""
    return rows.join(table.select(*keys).distinct(), list(keys), "left_anti")


def present(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(table.select(*keys).distinct(), list(keys), "left_semi")


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with ``rows`` in place of those with the same key."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def inserted(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the rows whose key it lacks."""
    return table.unionByName(missing(rows, table, keys))


def encoded(column: str):
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def decoded(column: str, kind: str = "MAP<STRING,STRING>"):
    return F.from_json(F.col(column), kind)


def merged_metrics(a: str, b: str):
    """Two metric maps as one; the second's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), F.col(b))


class Store:
    """Tables under one folder.

    A table is a folder of versions.  A version counts once Spark has marked it as complete; the
    last one is the table.  So an update that breaks off, wherever it does, leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _files(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """The complete versions of a table."""
        where, fs = self._files(self._at(name))
        if not fs.exists(where):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(where)]
        return sorted(int(x[8:]) for x in found if x.startswith("version=") and fs.exists(self._files(f"{self._at(name)}/{x}/_SUCCESS")[0]))

    def read(self, name: str, schema: str) -> DataFrame:
        found = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self._at(name)}/version={found[-1]}") if found else self.spark.createDataFrame([], schema)

    def insert(self, name: str, schema: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Adds the rows whose key the table lacks."""
        found = self.versions(name)
        missing(rows, self.read(name, schema), keys).write.mode("append").parquet(f"{self._at(name)}/version={found[-1] if found else 0}")

    def update(self, name: str, schema: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """The stored table with ``rows`` in place of those of the same keys, as a new version.

        Frames read before still find the version before; older ones go.
        """
        found = self.versions(name)
        new = found[-1] + 1 if found else 0
        upserted(self.read(name, schema), rows, keys).write.mode("overwrite").parquet(f"{self._at(name)}/version={new}")
        for old in found[:-1]:
            where, fs = self._files(f"{self._at(name)}/version={old}")
            fs.delete(where, True)

    def files(self, name: str = "") -> DataFrame:
        """The store's files: path, length and time of the last change."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self._at(name))
        return found.select("path", "length", F.col("modificationTime").alias("changed"))

    def stored(self, rows: DataFrame) -> DataFrame:
        """The rows (algorithm_id, image_id, ..) whose labels are stored."""
        there = self._segments("labels").select("algorithm_id", "image_id")
        return rows.join(there.distinct(), ["algorithm_id", "image_id"], "left_semi")

    def save_segments(self, labels: DataFrame, regions: DataFrame, algorithm_id: int | None = None) -> None:
        """Labels and region means, partitioned by algorithm and ranges of images; what is there of the same images is replaced.

        Frames without ``algorithm_id`` are of the one that is given."""
        folder, key = F.expr(f"image_id div {IMAGES}"), ["algorithm_id", "image_id"]
        for name, df in (("labels", labels), ("regions", regions)):
            number = F.col("algorithm_id") if algorithm_id is None else F.lit(algorithm_id)
            new = df.withColumns({"algorithm_id": number.cast("long"), "images": folder})
            where, fs = self._files(f"{self.path}/_kept/{uuid.uuid4().hex}")
            if fs.exists(self._files(self._at(name))[0]):
                # other images of the same folders, which are written anew
                old = self._segments(name).withColumn("images", folder)
                old = missing(present(old, new, ["algorithm_id", "images"]), new, key).select(*new.columns)
                old.write.parquet(where.toString())
                new = new.unionByName(self.spark.read.schema(old.schema).parquet(where.toString()))
            out = new.repartition("algorithm_id", "images", F.expr(f"image_id % {WRITERS}"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("algorithm_id", "images").parquet(self._at(name))
            fs.delete(where, True)

    def _segments(self, name: str) -> DataFrame:
        """All rows of ``labels`` or ``regions``."""
        rows = self.spark.read.parquet(self._at(name)).drop("images")
        return rows.withColumn("algorithm_id", F.col("algorithm_id").cast("long"))

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` written under the store once and read again; ``dropped`` removes all of these."""
        path = f"{self.path}/_kept/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self) -> None:
        where, fs = self._files(f"{self.path}/_kept")
        fs.delete(where, True)

    def labels(self, algorithm_id: int) -> DataFrame | None:
        """All stored labels of an algorithm, or None."""
        where, fs = self._files(f"{self._at('labels')}/algorithm_id={algorithm_id}")
        return self.spark.read.parquet(where.toString()).drop("images") if fs.exists(where) else None

    def load_segments(self, image_id: int, algorithm_id: int) -> DataFrame:
        rows = self.spark.read.parquet(self._at("labels")).where((F.col("images") == F.expr(f"{int(image_id)}L div {IMAGES}")) & (F.col("image_id") == image_id))
        return rows.where(F.col("algorithm_id") == algorithm_id).drop("images")

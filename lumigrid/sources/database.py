"""The result store in a database, over JDBC: tables made from record types, rows inserted and updated by key.

Spark's tasks write rows to a table of their own beside the target; the database then takes them over by key
in one transaction, so an insert or update is whole or not at all, however many tasks wrote and
whatever was lost on the way, and inserting twice does nothing.  Maps are kept as JSON text.  Reads are split by id;
conditions on columns go to the database.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.sources.store import encoded, lookup, table_name

#: Column types by those of a record's fields; maps and anything else are text.
KINDS = {int: "BIGINT", float: "DOUBLE PRECISION", bool: "BOOLEAN"}


class Database:
    def __init__(self, spark: SparkSession, url: str, driver: str | None = None, text: str = "VARCHAR(4000)", **properties: str):
        """``text``: the database's type of text that can be compared; ``properties``: user, password and the like."""
        self.spark, self.url, self.driver, self.text, self.properties = spark, url, driver, text, properties

    def _connected(self, act):
        """``act`` with a connection whose statements are one transaction."""
        jvm = self.spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        if self.driver:
            jvm.java.lang.Class.forName(self.driver, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            connection.setAutoCommit(False)
            out = act(connection)
            connection.commit()
            return out
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def execute(self, *statements: str) -> None:
        """The statements as one transaction."""

        def act(connection) -> None:
            for s in statements:
                statement = connection.createStatement()
                statement.executeUpdate(s)
                statement.close()

        self._connected(act)

    def has(self, name: str) -> bool:
        def act(connection) -> bool:
            meta = connection.getMetaData()
            return any(meta.getTables(None, None, n, None).next() for n in (name, name.upper(), name.lower()))

        return self._connected(act)

    def create_table_sql(self, kind: type) -> str:
        fields = [f"{n} {KINDS.get(t, self.text)}" for n, t in get_type_hints(kind).items() if n != "id"]
        return f"CREATE TABLE {table_name(kind)} (id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, {', '.join(fields)})"

    def create(self, kind: type) -> str:
        """The record type's table, made where it is missing; its name."""
        if not self.has(table_name(kind)):
            self.execute(self.create_table_sql(kind))
        return table_name(kind)

    def _options(self, rows) -> object:
        rows = rows.format("jdbc").option("url", self.url)
        rows = rows.option("driver", self.driver) if self.driver else rows
        return rows.options(**self.properties)

    def read(self, name: str, partitions: int = 8) -> DataFrame:
        """A table, column names in lower case, read by ranges of its id."""
        query = f"(SELECT min(id) AS low, max(id) AS high FROM {name}) bounds"
        low, high = self._options(self.spark.read).option("dbtable", query).load().first()
        reader = self._options(self.spark.read).option("dbtable", name)
        if low is not None and high > low:
            reader = reader.options(partitionColumn="id", lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions)
        found = reader.load()
        return found.toDF(*[c.lower() for c in found.columns])

    def _taken(self, name: str, rows: DataFrame, keys: Sequence[str], statements) -> None:
        """Writes ``rows`` beside the table, then runs ``statements(columns, values, source, same)`` as one transaction."""
        maps = [f.name for f in rows.schema if isinstance(f.dataType, T.MapType)]
        rows = rows.withColumns({c: encoded(c) for c in maps}).drop("id")
        stage = f"stage_{uuid.uuid4().hex[:16]}"
        # Spark writes text in the widest type there is, which some databases cannot compare
        own = {f.name: f'{stage}."{f.name}"' for f in rows.schema}
        value = {f.name: f"CAST({own[f.name]} AS {self.text})" if isinstance(f.dataType, T.StringType) else own[f.name] for f in rows.schema}
        same = " AND ".join(f"({name}.{k} = {value[k]} OR {name}.{k} IS NULL AND {own[k]} IS NULL)" for k in keys)
        self._options(rows.write).option("dbtable", stage).save()
        try:
            self.execute(*statements(", ".join(rows.columns), ", ".join(value.values()), stage, same))
        finally:
            self.execute(f"DROP TABLE {stage}")

    def insert(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Adds the rows whose key the table lacks."""
        self._taken(name, rows, keys, lambda columns, values, stage, same: [f"INSERT INTO {name} ({columns}) SELECT {values} FROM {stage} WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE {same})"])

    def update(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Puts the rows in place of those of the same keys."""

        def statements(columns: str, values: str, stage: str, same: str) -> list[str]:
            return [f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {same})", f"INSERT INTO {name} ({columns}) SELECT {values} FROM {stage}"]

        self._taken(name, rows, keys, statements)

    def get(self, name: str, **values: object):
        """The row equal in all named fields (null matches null); an error if there is none."""
        found = lookup(self.read(name), **values).orderBy("id").limit(1).collect()
        if not found:
            raise LookupError(f"no row with {values}")
        return found[0]

    def get_or_insert(self, name: str, **values: object):
        """The row of these fields, inserted where it is missing."""
        kinds = {c: t for c, t in self.read(name).dtypes if c in values}
        row = self.spark.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in values.items()])
        self.insert(name, row, list(values))
        return self.get(name, **values)

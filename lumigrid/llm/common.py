"""What the text operators share: tables, the shared folder and materialising."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space and letters of the contracts, which look at ASCII only.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0A\x0B\x0C\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named a local one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumigrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again.

    This cuts the lineage: lost executors cost no recomputation of what came
    before, and a frame used twice is computed once.  The files lie in a folder
    of the application and stay until ``cleared`` or until the folder goes.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lumigrid-{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Removes all that ``written`` left for this application."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch of texts, unless the session names another number.
ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches have few rows: texts are long, and workers and the
    memory beside the heap hold several batches."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(ROWS))
    return df


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which a worker gives memory that it no longer uses back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run

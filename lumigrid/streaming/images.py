"""Images that arrive: a stream over a folder of pixels, segmented batch by batch (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumigrid.model import PIXELS
from lumigrid.operators import regions
from lumigrid.operators.segment import segment


def whole(pixels: DataFrame, size: int) -> DataFrame:
    """A stream's pixels, image by image: those of an image are held until all ``size`` of them have come.

    A pixel that comes again (equal image_id and pid) counts once.
    """

    def held(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        rows = pd.concat([*before, *parts]).drop_duplicates("pid")
        if len(rows) >= size:
            state.remove()
            yield rows
            return
        table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        state.update((out.getvalue().to_pybytes(),))

    return pixels.groupBy("image_id").applyInPandasWithState(held, PIXELS, "rows binary", "append", GroupStateTimeout.NoTimeout)


def segment_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: object, once: bool = True, size: int | None = None, files: int = 1000) -> StreamingQuery:
    """Writes labels of each new image under ``target``/labels and region summaries under ``target``/regions.

    ``size``: pixels of an image, which may then come in any number of files; without it an image's
    rows must lie in one file.  ``files``: files of a micro-batch at most.  A batch that runs
    again after a failure overwrites its own folder, so nothing is doubled.
    """
    pixels = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files).parquet(source)
    pixels = pixels if size is None else whole(pixels, size)

    def run(batch: DataFrame, number: int) -> None:
        labels = segment(batch, config)
        labels.write.mode("overwrite").parquet(f"{target}/labels/batch={number}")
        done = batch.sparkSession.read.parquet(f"{target}/labels/batch={number}")
        summary = regions.summary(batch.drop("label").join(done.select("image_id", "pid", "label"), ["image_id", "pid"]))
        summary.write.mode("overwrite").parquet(f"{target}/regions/batch={number}")

    stream = pixels.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

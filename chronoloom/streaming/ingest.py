"""Streams of rows into a store.

Late rows are taken however late they are, so there is no watermark by default; a store that takes no
outdated rows may be given one, which bounds what it has to remember.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

#: Numbers for the rows of one micro-batch.
BATCH_ROWS = 1 << 40


def start_ingest(rows: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch of rows (metric, labels, ts, value) to the store.

    seq orders batches by number and rows within one by partition and place, if rows have none. A batch
    is an append named by the stream (its checkpoint) and its number: one that is run again after it
    was committed changes nothing, one that wasn't is written over.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def append(batch: DataFrame, number: int) -> None:
        numbered = batch if "seq" in batch.columns else batch.withColumn("seq", F.lit(number * BATCH_ROWS) + F.monotonically_increasing_id())
        store.append(numbered, name=f"{stream}-{number:012d}")

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_rows(spark, path: str, schema: str, max_files: int = 1_000) -> DataFrame:
    """A stream of the Parquet files of a folder, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)

"""Watch mode: scans arrive as a stream of files; each micro-batch is merged into the stored file table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import apply, diff, record_removed
from ..operators.merge import cut, read_or_empty, write_atomic
from ..store import SCHEMAS

def watch(spark: SparkSession, scans: str, schema: str, table: str, table_schema: str, checkpoint: str, removed: str, roots: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Start merging scan files (Parquet, one snapshot a batch) into table; with once, stop when all present ones are done.

    Deleted files go to the table removed, so that their ids are not given away again and a file that returns gets its own back.
    That table is written first: a batch replayed after a failure records the same files again, finds its own live and changes
    nothing more.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        files, gone = read_or_empty(spark, table, table_schema), read_or_empty(spark, removed, SCHEMAS["removed_files"])
        d = diff(batch, files, gone, roots)
        back = d.returned.select("item_id")
        after = cut(record_removed(files, d.deleted, None, gone, int(time.time())))
        merged = cut(apply(files, d, after))
        write_atomic(after.join(back, "item_id", "left_anti").select(*gone.columns), removed, {"batch": batch_id})
        write_atomic(merged, table, {"batch": batch_id})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(scans)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()

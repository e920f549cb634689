"""Calls as a stream: landing, de-duplication, live activity and keyed writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.activity import bucket_sums
from ..plans.ingest import publish
from ..plans.store import TABLES, Store

# A pass every this often when the stream runs on.
INTERVAL = "30 seconds"


def read_landed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a landing folder as a stream, all there are per trigger unless a number is given.

    A growing log is not followed by a file stream. The ingest pass writes the
    rows of what changed as files of their own, below ``<store>/calls``, which
    is a landing folder as it stands.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def read_landed_calls(spark: SparkSession, folder: str) -> DataFrame:
    return read_landed(spark, folder, schemas.CALLS).withColumn(
        "event_time", F.timestamp_seconds(F.nullif(F.col("ts"), F.lit(0)))
    )


def first_of_each(calls: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Calls whose key was not seen within the watermark; for when the first copy is as good as any."""
    return calls.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["session_uid", "call_key"])


def live_activity(calls: DataFrame, step: int, lateness: str = "1 day") -> DataFrame:
    """Tumbling buckets of dated calls, the same epoch-aligned ones as the batch report.

    Only this live view lets go of calls later than ``lateness``; the stored tables
    take them, and the batch report over those is the truth.
    """
    dated = calls.filter("event_time is not null").withWatermark("event_time", lateness)
    grouped = dated.groupBy(F.window("event_time", f"{step} seconds").alias("w"))
    figures = bucket_sums(grouped)
    return figures.select(F.unix_seconds("w.start").alias("bucket"), *[c for c in figures.columns if c != "w"])


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    """Run a stream into a batch function: everything there is, or every 30 seconds."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def upsert_into(store: Store, table: str = "calls") -> Callable[[DataFrame, int], None]:
    """Batch function that adds rows to a stored table, the newest write of a key winning when it is read.

    An empty batch writes nothing. The batch is computed once. One that is run
    again after a failure adds the same rows a second time, which changes
    nothing.
    """
    columns = store.spark.createDataFrame([], TABLES[table][1]).columns

    def sink(batch: DataFrame, _id: int) -> None:
        rows = batch.select(*columns).persist()
        try:
            if not rows.isEmpty():
                publish(store, {table: rows})
        finally:
            rows.unpersist()

    return sink

"""Event-time windows, batch and streaming (an addition: the described system has
no streams).  Timestamps without a zone are read as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total).  late: watermark, for streams."""
    source = timed(events)
    if late:
        source = source.withWatermark("ts", late)
    out = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): a user's events no further apart than the gap."""
    source = timed(events)
    if late:
        source = source.withWatermark("ts", late)
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read(spark: SparkSession, folder: str, schema, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def ingest_stream(docs: DataFrame, out: str, checkpoint: str):
    """Appends documents whose hash has not come before, each batch once.  The hashes
    seen are keyed state of the query, so a batch costs what it holds, not what the
    store holds; they live in the checkpoint, with which a store belongs together.
    Of equal texts any one row stays; null texts count as equal."""
    from folioforge.operators import ingest

    new = ingest.hashed(docs).dropDuplicates(["source_hash"])
    options = {"path": out, "checkpointLocation": checkpoint}
    return new.writeStream.format("parquet").outputMode("append").options(**options).trigger(availableNow=True).start()

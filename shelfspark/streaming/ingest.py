"""Structured Streaming forms of the ingest: a versioned store kept by foreachBatch, and windowed counts.

The store lives in a folder of versions with pointers, as every published table does. A batch reads
the current version, applies the upsert, writes the next version and a pointer to it; a batch that
is replayed after a failure finds equal bodies and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.plans import catalog
from shelfspark.sources import raw_store


def current_store(spark: SparkSession, folder: str) -> DataFrame:
    """The store's current version, empty before the first batch only: a lost pointer is an error, no empty store."""
    try:
        return catalog.read_published(spark, folder, "store")
    except LookupError:
        return raw_store.empty(spark)


def upsert_stream(rows: DataFrame, folder: str, checkpoint: str, seq: str = "seq", is_live: bool = True, now=None) -> StreamingQuery:
    """Keep a store up to date from a stream of (ppn, record, seq); the last row of a key in a batch counts.

    now: gives a batch's stamp from its number; by default the time at which it runs.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stamp = now(number) if now else spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
        last = raw_store.latest(batch.select("ppn", "record", seq), seq).select("ppn", "record")
        catalog.publish({"store": raw_store.put(current_store(spark, folder), last, stamp, is_live)}, folder, f"v{number}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_keys(rows: DataFrame, time: str = "ts", key: str = "ppn", delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 day", streaming: bool = True) -> DataFrame:
    """Events and value per window and type; late ones beyond the watermark are left out of a stream."""
    rows = events.withWatermark("ts", delay) if streaming else events
    grouped = rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", delay: str = "1 day", streaming: bool = True) -> DataFrame:
    """Events per overlapping window."""
    rows = events.withWatermark("ts", delay) if streaming else events
    return rows.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day", streaming: bool = True) -> DataFrame:
    """Events per user session."""
    rows = events.withWatermark("ts", delay) if streaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

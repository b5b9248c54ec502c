"""Streaming ingestion: content dedup per mailbox and an idempotent sink in several phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.operators import archive, ingest
from postmill.session import exists


def identified(raw: DataFrame) -> DataFrame:
    """Adds content_hash and id to (account, raw) rows, batch or stream."""
    return raw.withColumn("content_hash", ingest.content_hash(F.col("raw"))).withColumn("id", ingest.message_key(F.col("account"), F.col("content_hash")))


def unique(stream: DataFrame) -> DataFrame:
    """Each content of a mailbox once, however late it comes again; the state holds keys only."""
    return stream.dropDuplicates(["account", "content_hash"])


def unique_within(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """Like ``unique`` but the state forgets keys older than ``delay`` behind the newest event time."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["account", "content_hash"])


def daily_counts(stream: DataFrame, at: str, delay: str = "30 days") -> DataFrame:
    """Messages by account and day of event time."""
    return stream.withWatermark(at, delay).groupBy("account", F.window(at, "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def write_once(batch: DataFrame, batch_id: int, path: str, key: str = "id", buckets: int = 64) -> None:
    """Sink of one micro-batch: rows whose key the table holds already are left out, so that a replayed
    batch adds nothing."""
    spark = batch.sparkSession
    # what the table holds is asked for by key only; a table partitioned by bucket is read in the batch's buckets
    rows = archive.newest(batch, key, ()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        held = spark.read.parquet(path).where(F.col("bucket").isin(*touched)).select("bucket", key)
        rows = rows.join(held, ["bucket", key], "left_anti")
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ingest all there is now, then stop; offsets advance only after the sink has written."""
    return (
        unique(stream).writeStream.foreachBatch(lambda b, n: write_once(b, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

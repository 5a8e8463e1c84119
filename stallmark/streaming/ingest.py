"""Incremental ingestion: idempotent upsert of listing state, and windowed aggregation of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallmark.session import cut, discard


def merge_state(old: DataFrame | None, seen: DataFrame) -> DataFrame:
    """State per key after new sightings: ``key``, ``first_seen``, ``last_seen``, ``sightings`` (number).

    ``seen``: ``key``, ``sighting``, ``at``, without those the state counts already. No row grows with the number of
    sightings of its key.
    """
    new = seen.groupBy("key").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
    if old is None:
        return new
    return old.unionByName(new).groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def upsert_stream(stream: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of a stream of ``key``, ``sighting``, ``at`` under ``state_path``; restarts repeat a batch safely.

    ``sightings``/batch=<n> holds the (key, sighting) pairs a batch brought, each once in the whole folder; v=<n> holds
    the state per key after batch n. A batch that is delivered again writes the same folders again. The two newest
    states are kept.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark, ledger = batch.sparkSession, f"{state_path}/sightings"
        fresh = batch.filter("key is not null and sighting is not null").groupBy("key", "sighting").agg(F.min("at").alias("at"))
        if _exists(spark, ledger):
            known = spark.read.schema("key string, sighting string, batch bigint").parquet(ledger).filter(F.col("batch") < n).select("key", "sighting")
            fresh = fresh.join(known, ["key", "sighting"], "left_anti")
        fresh = cut(fresh)
        fresh.select(F.col("key").cast("string"), F.col("sighting").cast("string")).write.mode("overwrite").parquet(f"{ledger}/batch={n}")
        merge_state(latest_state(spark, state_path, before=n), fresh).write.mode("overwrite").parquet(f"{state_path}/v={n:09d}")
        discard(fresh)
        retire(spark, state_path, n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retire(spark: SparkSession, state_path: str, n: int) -> None:
    """Remove states older than the one before batch ``n``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    for old in [x for x in names if int(x[2:]) < n][:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{state_path}/{old}"), True)


def latest_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """Newest version of the state (below batch ``before``), or None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    names = [n for n in names if (before is None or int(n[2:]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{state_path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{state_path}/{names[-1]}") if names else None


def event_windows(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Tumbling windows of an event stream under a watermark: count, total and users (approximate) per type."""
    return (
        events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.approx_count_distinct("user_id").alias("users"))
        .select("event_type", F.col("w.start").alias("window_start"), "n", "total", "users")
    )


def unique_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events once each, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

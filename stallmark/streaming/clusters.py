"""Clusters kept up to date while matches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallmark.operators import graph
from stallmark.streaming.ingest import latest_state, retire


def merge_clusters(old: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``id``, ``component`` after new edges ``a``, ``b``: components over the old labels, as stars, and the new edges.

    The result is that of all edges at once, in whatever batches they came; the edges of old batches are not read again.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    if old is not None:
        stars = old.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        return graph.components(e.unionByName(stars))
    return graph.components(e)


def cluster_stream(stream: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the labels of a stream of ``a``, ``b`` under ``state_path``/v=<batch>; a batch delivered again gives the same labels."""

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        merge_clusters(latest_state(spark, state_path, before=n), batch).write.mode("overwrite").parquet(f"{state_path}/v={n:09d}")
        retire(spark, state_path, n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clusters(spark: SparkSession, state_path: str) -> DataFrame | None:
    return latest_state(spark, state_path)

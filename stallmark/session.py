"""Session helpers: building a session, loading tables, cutting lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "stallmark", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; pruning and pushdown happen in the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "stallmark-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write to a table in the shared checkpoint folder and read it back: the lineage ends, lost executors cost nothing.

    A written table is preferred to checkpoint() here: a checkpointed frame keeps the size estimate of its plan, and the
    estimates of joins of joins multiply over the rounds of an iteration until the driver is busy with numbers of
    millions of digits. A table has the size of its files. It is removed by
    :func:`discard`, or when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that :func:`cut` wrote and no later plan reads; other frames are left alone."""
    for f in frames:
        path = getattr(f, "_cut_path", None)
        if path is not None:
            where = f.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(f.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished rounds of an iteration left: plans, broadcasts, shuffle and checkpoint files.

    Spark removes these only when the driver collects its garbage, which an idle heap may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few small files a partition per core before costly Python work; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

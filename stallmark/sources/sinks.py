"""Sinks: append of JSON lines, raw artefacts, insert of absent rows, dead letters, and the stamp of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.sources.records import flat_export, split_valid


def stamp(df: DataFrame, run_id: str, version: str, at: str) -> DataFrame:
    """Add the metadata of a run; the time is given, never read from the clock, so that a repeated run writes the same."""
    return df.withColumns({"run_id": F.lit(run_id), "collector_version": F.lit(version), "ingested_at": F.lit(at).cast("timestamp")})


def append_lines(df: DataFrame, path: str) -> None:
    """Append as JSON lines; files are added, none is rewritten."""
    df.write.mode("append").json(path)


def keep_raw(spark: SparkSession, files: str, path: str, case: str) -> None:
    """Keep raw artefacts as they came (name, bytes, hash) under ``path``/case=<case>; a file of the same content is kept once."""
    raw = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content", F.sha2("content", 256).alias("sha256"), F.lit(case).alias("case"))
    raw.dropDuplicates(["sha256"]).write.mode("append").partitionBy("case").parquet(path)


def insert_absent(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key the table at ``path`` does not hold, of equal keys one; returns how many. Null keys are left out.

    Only keys are read from the table, so its width does not matter; existing rows stay as they are.
    """
    spark = new.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = new.dropna(subset=keys).dropDuplicates(keys)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    before = spark.read.parquet(path).count() if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def relationship_records(pairs: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """One record a pair and kind whatever the direction: ``relationship_id``, ``a``, ``b``, ``kind``, ``seen`` (how often)."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("a"), hi.alias("b"), F.col(kind).alias("kind"))
    g = p.groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("seen"))
    return g.select(F.concat(F.lit("REL-"), F.left(F.sha2(F.to_json(F.struct("a", "b", "kind")), 256), F.lit(12))).alias("relationship_id"), "a", "b", "kind", "seen")


def ingest(records: DataFrame, table: str, dead: str, keys: list[str], run_id: str, version: str, at: str) -> int:
    """Valid records flat into the table (absent keys only), invalid ones with their errors to the dead letters; returns the inserted rows."""
    good, bad = split_valid(records)
    append_lines(stamp(bad, run_id, version, at), dead)
    return insert_absent(stamp(flat_export(good), run_id, version, at), table, keys)

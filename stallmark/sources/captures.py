"""Capture exports: nested JSON files to sightings and media references, and the export of deduplicated captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTING = """struct<listing_id:string,source_url:string,
raw:struct<title:string,price:string,location:string,date:string,description:string>,
normalized:struct<title:string,price:struct<amount:double,currency:string>,location:string,posted_text:string>,
badges:struct<featured:boolean,verified:boolean,elite:boolean>,contact_actions:struct<chat_available:boolean,call_available:boolean>,
media:array<struct<file_id:string,src:string,gallery_index:int,alt:string>>,attributes:map<string,string>,
description:struct<text:string,paragraphs:array<string>>,seller:struct<display_name:string,profile_url:string,seller_type:string,account_age:string,profile_location:string>>"""
CAPTURE = f"""struct<capture_id:string,captured_at:string,page_type:string,source_url:string,
capture_context:struct<search_query:string,category_id:string,total_rendered_cards:int>,listings:array<{LISTING}>>"""
EXPORT = f"schema_version string, source string, exported_at string, captures_count int, captures array<{CAPTURE}>".replace("\n", "")


def read_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contents of the distinct files and a manifest of all: of equal files the first by name is read.

    Bytes are hashed where they lie; only hashes and names are shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"))
    first = F.first("file_name").over(Window.partitionBy("sha256").orderBy("file_name", "path"))
    rank = F.row_number().over(Window.partitionBy("sha256").orderBy("file_name", "path"))
    manifest = files.withColumn("r", rank).select("file_name", "path", "sha256", "size_bytes", (F.col("r") > 1).alias("is_duplicate"), F.when(F.col("r") > 1, first).alias("identical_to"))
    docs = spark.read.schema(EXPORT).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file_path"))
    keep = manifest.filter("not is_duplicate").select(F.regexp_replace("path", "^file:/+", "/").alias("k"), "file_name", "sha256")
    return docs.withColumn("k", F.regexp_replace("file_path", "^file:/+", "/")).join(keep, "k").drop("k", "file_path"), manifest


def sightings(docs: DataFrame) -> DataFrame:
    """One row a listing of a capture. Missing capture ids, page types and listing ids get their defaults; without any id a listing is left out."""
    c = docs.select("file_name", "sha256", "source", F.posexplode("captures").alias("capture_pos", "c"))
    x = c.select("*", F.posexplode("c.listings").alias("listing_pos", "l"))
    return x.select(
        "file_name", "source", "capture_pos", "listing_pos", F.coalesce("c.capture_id", F.concat(F.lit("cap-"), F.left("sha256", F.lit(8)))).alias("capture_id"), F.col("c.captured_at").alias("captured_at"),
        F.coalesce("c.page_type", F.lit("search")).alias("page_type"), F.col("c.capture_context.search_query").alias("search_query"), F.col("c.capture_context.category_id").alias("category_id"),
        F.coalesce(F.nullif("l.listing_id", F.lit("")), F.nullif("l.source_url", F.lit(""))).alias("listing_id"), F.col("l.source_url").alias("source_url"), F.col("l.raw.title").alias("raw_title"),
        F.col("l.normalized.title").alias("normalized_title"), F.col("l.raw.price").alias("raw_price"), F.col("l.normalized.price.amount").alias("price_amount"), F.col("l.raw.location").alias("raw_location"), F.col("l.media").alias("media"),
    ).filter("listing_id is not null")


def media_references(seen: DataFrame) -> DataFrame:
    """``MED-<listing>-<index>`` rows, one a listing and index whatever the number of captures."""
    m = seen.select("listing_id", "capture_pos", F.posexplode("media").alias("pos", "m"))
    m = m.select("listing_id", F.coalesce("m.gallery_index", "pos").alias("gallery_index"), F.col("m.file_id").alias("file_id"), F.col("m.src").alias("src"), "capture_pos")
    first = m.groupBy("listing_id", "gallery_index").agg(F.min_by(F.struct("file_id", "src"), F.struct("capture_pos", "src")).alias("x"))
    return first.select(F.concat(F.lit("MED-"), "listing_id", F.lit("-"), F.col("gallery_index").cast("string")).alias("media_id"), "listing_id", "gallery_index", "x.file_id", "x.src")


def deduplicated_captures(seen: DataFrame) -> DataFrame:
    """First sighting of each listing in capture order, regrouped by capture; captures left empty disappear."""
    first = seen.withColumn("r", F.row_number().over(Window.partitionBy("listing_id").orderBy("capture_pos", "listing_pos"))).filter("r = 1")
    return first.groupBy("file_name", "capture_id").agg(F.count(F.lit(1)).alias("listings_count"), F.array_sort(F.collect_list(F.struct("listing_pos", "listing_id"))).alias("listings"))

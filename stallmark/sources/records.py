"""Record files (JSON, CSV), a directory source, dead letters and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stallmark.functions import parsing, price

SUBMISSION = """source string, source_listing_id string, source_url string, title string, description string, category string, subcategory string, brand string, model string,
price string, currency string, condition string, location string, posted_at string,
seller struct<display_name:string,account_age:string,profile_location:string,verification_status:string,seller_type:string,phone:string,email:string>,
media array<struct<media_type:string,source_url:string,sha256:string>>, extracted_claims map<string,string>, synthetic boolean""".replace("\n", "")

#: Other names under which a CSV may carry a field.
ALIASES = {"title": ["raw_title", "name"], "price": ["raw_price"], "description": ["raw_description"], "source_url": ["url", "listing_url"], "source_listing_id": ["listing_id", "id"], "location": ["raw_location"], "condition": ["raw_condition"]}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records or single records."""
    return spark.read.schema(SUBMISSION).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; the first non-empty of a field and its other names counts; ``synthetic`` is true, 1 or yes."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().lower(): c for c in raw.columns}

    def field(name: str) -> Column:
        named = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in [name, *ALIASES.get(name, [])] if n in have]
        return F.coalesce(*named) if named else F.lit(None).cast("string")

    flat = ["source", "source_listing_id", "source_url", "title", "description", "category", "brand", "model", "price", "currency", "condition", "location", "posted_at"]
    return raw.select(*[field(c).alias(c) for c in flat], F.lower(F.coalesce(field("synthetic"), F.lit("false"))).isin("true", "1", "yes").alias("synthetic"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV, else JSON."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_json(spark, path)


def canonical(records: DataFrame) -> DataFrame:
    """Canonical form: deterministic id, default title, amount, currency, condition class, city and state."""
    key = F.coalesce(F.concat_ws("|", "source", "source_listing_id", "source_url", "title"), F.lit(""))
    city, state = parsing.city_and_state(F.col("location"))
    return records.select(
        F.concat(F.lit("lst_"), F.left(F.sha2(key, 256), F.lit(12))).alias("listing_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("[NO TITLE]")).alias("title"),
        price.amount(F.col("price")).alias("price_amount"), price.currency(F.col("currency")).alias("price_currency"), parsing.condition_field(F.col("condition")).alias("condition_class"), city.alias("city"), state.alias("state"), *[c for c in records.columns if c not in ("title",)],
    )


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and dead letters with their errors and the raw record as JSON."""
    e = records.withColumn("errors", parsing.record_errors(F.col("title"), F.col("source"), F.col("price")))
    bad = e.filter(F.size("errors") > 0).select("errors", F.to_json(F.struct(*records.columns)).alias("raw_record"))
    return e.filter(F.size("errors") == 0).drop("errors"), bad


def flat_export(records: DataFrame) -> DataFrame:
    """Flat rows for Parquet: seller fields lifted, media counted, maps as JSON."""
    kinds = dict(records.dtypes)
    out = [F.col(c) for c, k in kinds.items() if not k.startswith(("struct", "array", "map"))]
    out += [F.col(f"seller.{f.name}").alias(f"seller_{f.name}") for f in records.schema["seller"].dataType.fields] if "seller" in kinds else []
    out += [F.coalesce(F.size("media"), F.lit(0)).alias("media_count")] if "media" in kinds else []
    return records.select(*out, *[F.to_json(c).alias(f"{c}_json") for c, k in kinds.items() if k.startswith("map")])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options.get("path", "")

    def partitions(self) -> list[_File]:
        import glob

        return [_File(p) for p in sorted(glob.glob(f"{self.folder}/**/*.json", recursive=True))] or [_File("")]

    def read(self, part: _File):
        import json
        import os

        if part.path:
            with open(part.path, encoding="utf-8") as f:
                data = json.load(f)
            for r in data if isinstance(data, list) else [data]:
                yield os.path.basename(part.path), json.dumps(r, ensure_ascii=False, sort_keys=True)


class RecordFolder(DataSource):
    """Connector in Spark's Python data source form: ``spark.read.format("record_folder").load(folder)``; one task a file."""

    @classmethod
    def name(cls) -> str:
        return "record_folder"

    def schema(self) -> str:
        return "file_name string, record string"

    def reader(self, schema) -> _FolderReader:
        return _FolderReader(self.options)

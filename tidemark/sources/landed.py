"""Landed files: list and detail pages by source and page number, and attachments as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.files import html_payload
from ..functions.text import looks_blocked
from ..operators import scan
from .specs import SPECS, read_list

ATTACHMENT_CAP = 50 << 20


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages written as JSON lines or Parquet in the page schema."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(schemas.PAGE).json(path)


def scan_source(pages: DataFrame, name: str, max_pages: int | None = None, smoke: bool = False, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of one source up to the page where its scan stops, the last of each id, and its coverage row, which
    tells refused, failed, missing and empty pages too."""
    own = pages.where(F.col("source") == name)
    rows = read_list(own, SPECS[name]).withColumn("id", F.col("source_id"))
    asked = own.select("source", "page_no", "status", F.lit("other").alias("kind"), looks_blocked(F.col("html")).alias("blocked"), F.lit(max_pages).cast("long").alias("max_pages"))
    stats = scan.coverage(scan.controlled(asked, rows), least, smoke)
    kept = F.broadcast(stats.where("collected > 0").select("source", "stop_page"))  # one row
    held = rows.join(kept, "source").where(F.col("page_no") <= F.col("stop_page"))
    return scan.dedup(held, ["source", "id"], ["page_no", "row_no"], "last").drop("id", "stop_page"), stats


def read_attachments(spark: SparkSession, path: str, cap: int = ATTACHMENT_CAP) -> DataFrame:
    """path, length, sha256 and is_html of the files below a folder. The size is looked at before the content:
    files beyond the cap keep a null hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= cap).select("path", "length", F.sha2("content", 256).alias("sha256"), html_payload(F.col("content"), F.col("path")).alias("is_html"))
    large = files.where(F.col("length") > cap).select("path", "length", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("boolean").alias("is_html"))
    return small.unionByName(large)


def numeric_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id is digits alone."""
    return df.where(F.regexp_like(F.col(column), F.lit("^[0-9]+$")))

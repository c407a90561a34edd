"""Snapshots: folders of JSON lines in either list shape, read into one keyed form, with fail-closed checks."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

#: Files in a run's folder that are reports and not rows.
ARTEFACTS = ("new_items*", "screening*", "report*", "gone_*")


class SnapshotError(ValueError):
    """The input can't be trusted for a comparison."""


def unify(raw: DataFrame) -> DataFrame:
    """Both list shapes under (source, source_id); wrappers and unknown shapes go."""
    main = F.col("pbancSn").isNotNull()
    other = F.col("source").isNotNull() & F.col("id").isNotNull()
    own = raw.where((F.col("kind").isNull() | F.col("record").isNull()) & (main | other))
    filled = own.select(
        "*",
        F.when(main, F.coalesce("source", F.lit("kstartup"))).otherwise(F.col("source")).alias("__source"),
        F.when(main, F.col("pbancSn")).otherwise(F.col("id")).alias("source_id"),
        F.when(main, F.coalesce("apply_start", "start", F.lit(""))).otherwise(F.col("apply_start")).alias("__start"),
        F.when(main, F.coalesce("apply_end", "deadline", F.lit(""))).otherwise(F.col("apply_end")).alias("__end"),
    )
    names = ("title", "field", "org", "category", "program", "agency_type", "dday", "reg_date", "status", "url", "content_hash", "hash_version", "attachments_complete", "attachments")
    return filled.select(F.col("__source").alias("source"), "source_id", F.col("__start").alias("apply_start"), F.col("__end").alias("apply_end"), *names)


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A run's rows. Raises SnapshotError for a folder without row files, a broken line or a repeated key."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    files = [f"{folder}/{n}" for n in names if n.endswith(".jsonl") and not any(fnmatch.fnmatch(n, a) for a in ARTEFACTS)]
    if not files:
        raise SnapshotError(f"no row files in {folder}")
    raw = spark.read.schema(T.StructType([*schemas.RAW.fields, T.StructField("_broken", T.StringType())])).option("columnNameOfCorruptRecord", "_broken").json(files)
    if broken := raw.where("_broken is not null").select("_broken", "source").head(1):
        raise SnapshotError(f"broken line in {folder}: {broken[0][0][:120]}")
    rows = unify(raw.drop("_broken"))
    if twice := duplicate_keys(rows, "source", "source_id").head(1):
        raise SnapshotError(f"repeated key in {folder}: {tuple(twice[0])[:2]}")
    return rows


def write_snapshot(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)

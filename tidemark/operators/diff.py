"""Comparison of two snapshots, keyed by (source, source_id).

classify() meets both sides in one full outer join on slim projections: keys, compared fields and hashes; the
records are joined back only for what is reported. When one kind is asked for, new(), gone() and changed()
plan the anti or inner join directly, as the optimiser doesn't turn an outer join with a test into one.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source", "source_id"]
FIELDS = ("title", "apply_start", "apply_end", "status")
VERSION_LABEL = "hash_version(산식 전환 — 1회 상세 재검증)"
NEW, CHANGED, REHASH, GONE, SAME = "NEW", "CHANGED", "NEEDS_REHASH", "GONE", "UNCHANGED"


def _some(c: Column) -> Column:
    """Null, absent and empty are one."""
    return F.nullif(c, F.lit(""))


def _slim(df: DataFrame, side: str) -> DataFrame:
    has = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    return df.select(*KEY, *(_some(has(f, "string")).alias(f"{side}_{f}") for f in FIELDS), _some(has("content_hash", "string")).alias(f"{side}_hash"), has("hash_version", "int").alias(f"{side}_version"), F.lit(True).alias(f"{side}_here"))


def changed_fields() -> Column:
    same_version = F.col("p_version").eqNullSafe(F.col("c_version"))
    both = F.col("p_hash").isNotNull() & F.col("c_hash").isNotNull()
    listed = F.array_compact(F.array(*(F.when(~F.col(f"p_{f}").eqNullSafe(F.col(f"c_{f}")), F.lit(f)) for f in FIELDS), F.when(both & same_version & (F.col("p_hash") != F.col("c_hash")), F.lit("content_hash"))))
    return F.when((F.size(listed) == 0) & both & ~same_version, F.array(F.lit(VERSION_LABEL))).otherwise(listed)


def _kind_of_pair() -> Column:
    return F.when(F.size("changed_fields") > 0, CHANGED).when(F.col("p_hash").isNotNull() & F.col("c_hash").isNull(), REHASH).otherwise(SAME)


def sources(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """source, in_prev, in_curr."""
    each = prev.select("source", F.lit(True).alias("p"), F.lit(False).alias("c")).unionByName(curr.select("source", F.lit(False).alias("p"), F.lit(True).alias("c")))
    return each.groupBy("source").agg(F.bool_or("p").alias("in_prev"), F.bool_or("c").alias("in_curr"))


#: Distinct sources that may be broadcast; beyond that joins on them are planned without a hint.
FEW_SOURCES = 10_000


def few(df: DataFrame) -> DataFrame:
    """A table of distinct sources, to be joined with rows: broadcast if it is counted to be small, as a shuffle
    by source would gather all rows in a handful of tasks. Beyond FEW_SOURCES such a shuffle spreads them."""
    return F.broadcast(df) if df.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else df


def common_sources(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return prev.select("source").intersect(curr.select("source"))


def added_sources(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return curr.select("source").subtract(prev.select("source"))


def dropped_sources(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return added_sources(curr, prev)


def classify(prev: DataFrame, curr: DataFrame, carry_over: bool = True) -> DataFrame:
    """source, source_id, kind, changed_fields, new_source. Keys of sources that only the earlier run has are
    left out. Without carry-over (the profile changed) every current row is NEW, and GONE stays."""
    met = _slim(prev, "p").join(_slim(curr, "c"), KEY, "full_outer").join(few(sources(prev, curr)), "source")
    met = met.where(F.col("c_here").isNotNull() | F.col("in_curr"))
    pair = F.col("p_here").isNotNull() & F.col("c_here").isNotNull()
    fields = met.withColumn("changed_fields", F.when(pair, changed_fields()).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("p_here").isNull(), NEW).when(F.col("c_here").isNull(), GONE).otherwise(_kind_of_pair())
    done = fields.select(*KEY, kind.alias("kind"), "changed_fields", (~F.col("in_prev")).alias("new_source"))
    if not carry_over:
        fresh = F.when(F.col("kind") == GONE, GONE).otherwise(NEW)
        done = done.withColumn("kind", fresh).withColumn("changed_fields", F.array().cast("array<string>"))
    return done


def new(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return curr.join(prev.select(KEY), KEY, "left_anti").join(few(prev.select("source").distinct()), "source", "left_semi")


def gone(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return new(curr, prev)


def changed(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Pairs with a difference: source, source_id, changed_fields."""
    met = _slim(prev, "p").join(_slim(curr, "c"), KEY).withColumn("changed_fields", changed_fields())
    return met.where(F.size("changed_fields") > 0).select(*KEY, "changed_fields")


def review(classified: DataFrame) -> DataFrame:
    """What a reader should look at, with its place: new, of new sources, changed, to be hashed again."""
    rank = F.when((F.col("kind") == NEW) & ~F.col("new_source"), 1).when(F.col("kind") == NEW, 2).when(F.col("kind") == CHANGED, 3).when(F.col("kind") == REHASH, 4)
    return classified.withColumn("rank", rank).where("rank is not null")


def summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("kind", "new_source").agg(F.count(F.lit(1)).alias("n"))


def wrapped(classified: DataFrame, prev: DataFrame, curr: DataFrame) -> DataFrame:
    """kind, diff_status, changed_fields and the record: the current one, or for GONE the earlier one. Both
    sides meet the classified rows in one join, so these are worked out once."""
    names = [c for c in curr.columns if c not in KEY]
    record = lambda df, gone: df.select(*KEY, F.lit(gone).alias("__gone"), F.struct(*KEY, *((F.col(c) if c in df.columns else F.lit(None).cast(curr.schema[c].dataType)).alias(c) for c in names)).alias("record"))
    own = classified.withColumn("__gone", F.col("kind") == GONE)
    met = own.join(record(curr, False).unionByName(record(prev, True)), [*KEY, "__gone"])
    return met.select("kind", F.col("kind").alias("diff_status"), "changed_fields", "record")


def write(wrapped_rows: DataFrame, out: str) -> None:
    """Review rows and GONE rows as JSON lines in two folders; every key is written, nulls too. The rows are worked
    out once and kept for the second folder."""
    held = wrapped_rows.where(F.col("kind") != SAME).select("kind", F.to_json(F.struct("kind", "diff_status", "changed_fields", "record"), {"ignoreNullFields": "false"}).alias("value")).persist(StorageLevel.DISK_ONLY)
    try:
        held.where(F.col("kind") != GONE).select("value").write.mode("overwrite").text(out)
        head, _, tail = out.rpartition("/")
        held.where(F.col("kind") == GONE).select("value").write.mode("overwrite").text(f"{head}/gone_{tail}")
    finally:
        held.unpersist()


def unconfirmed(classified: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed rows, and GONE rows whose source's latest scan wasn't complete."""
    complete = few(manifest.where("status = 'ok'").select("source").distinct())
    lost = classified.where(F.col("kind") == GONE)
    return classified.where(F.col("kind") != GONE).unionByName(lost.join(complete, "source", "left_semi")), lost.join(complete, "source", "left_anti")


def report(wrapped_rows: DataFrame) -> DataFrame:
    """Two lines of text a record: source, title and deadline, then the address."""
    names = wrapped_rows.schema["record"].dataType.names
    r = lambda c, other: F.coalesce(F.nullif(F.col(f"record.{c}").cast("string"), F.lit("")), F.lit(other)) if c in names else F.lit(other)
    return wrapped_rows.select("kind", F.format_string("[%s] %s — 마감 %s\n    %s", r("source", ""), r("title", "(no title)"), r("apply_end", "?"), r("url", "")).alias("line"))

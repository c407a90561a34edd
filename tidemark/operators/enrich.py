"""Detail enrichment: hash versions, attachment states, keyed updates, dependent lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def complete(statuses: Column) -> Column:
    """All attachments are there; none at all counts as complete."""
    return F.forall(statuses, lambda s: F.coalesce(s == "ok", F.lit(False)))


def versioned_hash(body: Column, hashes: Column, statuses: Column) -> tuple[Column, Column]:
    """Content hash and its version: 3 with at least one attachment and all of them there, else 2."""
    full = (F.size(statuses) > 0) & complete(statuses)
    return F.when(full, X.content_hash(body, hashes)).otherwise(X.body_hash(body)), F.when(full, 3).otherwise(2)


def attachment_status(marked: Column, blocked: Column, sha: Column) -> Column:
    """A state set before stays; robots come before the download's outcome."""
    return F.coalesce(marked, F.when(blocked, "skipped_robots").when(sha.isNotNull(), "ok").otherwise("failed"))


def merge_detail(rows: DataFrame, details: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns of the details that match, on every row with the key; found tells which."""
    own = details.select(*key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__found"))
    met = rows.join(own, key, "left")
    return met.select(*(c for c in rows.columns if c not in columns), *(F.when(F.col("__found"), F.col(f"__{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in columns), F.coalesce("__found", F.lit(False)).alias("found"))


def failures(rows: DataFrame, key: str, order: str, status: str, most: int = 5) -> DataFrame:
    """Per key: the number of attachments that aren't ok, and the first few as text."""
    bad = rows.where(F.col(status) != "ok")
    each = F.array_sort(F.collect_list(F.struct(F.col(order), F.concat(F.col(order).cast("string"), F.lit(":"), F.col(status)).alias("text"))))
    return bad.groupBy(key).agg(F.count(F.lit(1)).alias("n_failed"), F.array_join(F.slice(F.transform(each, lambda x: x["text"]), 1, most), ", ").alias("failures"))


#: Fixed value: what a lookup page says when it has no files.
EMPTY_LOOKUP = "해당자료가 존재하지 않습니다"


def dependent_lookup(wanted: DataFrame, landed: DataFrame, key: str, page: str, pattern: str) -> DataFrame:
    """One row a file of the page that a key leads to. A missing page, or one without files that doesn't say
    so, gives one failed row: absence is never taken for 'no files'."""
    met = wanted.join(landed.select(key, page), key, "left")
    files = F.regexp_extract_all(F.col(page), F.lit(pattern), F.lit(1))
    state = F.when(F.col(page).isNull(), "failed").when(F.size(files) > 0, "listed").when(F.contains(F.col(page), F.lit(EMPTY_LOOKUP)), "empty").otherwise("failed")
    return met.select(*wanted.columns, state.alias("state"), F.explode_outer(F.coalesce(files, F.array().cast("array<string>"))).alias("file"))


def detail_text(url: Column, digest: Column, version: Column, attachments: Column, body: Column) -> Column:
    """A detail page as text: a head of four lines (address, hash, version, attachments), a blank one, the body."""
    head = F.concat_ws("\n", url, F.concat(F.lit("CONTENT_HASH: "), F.coalesce(digest, F.lit(""))), F.concat(F.lit("HASH_VERSION: "), F.coalesce(version.cast("string"), F.lit(""))), F.concat(F.lit("ATTACHMENTS: "), F.coalesce(F.to_json(attachments), F.lit("[]"))))
    return F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit("")))

"""Queries of the snapshot diff."""

from pyspark.sql import functions as F

from ..operators import diff as D
from ..sources.snapshot import duplicate_keys
from .recipes import CLASSIFIED, SNAPSHOTS, snapshots
from .registry import query


def _classified(t):
    return D.classify(*snapshots(t("documents")))


def joined():
    return F.array_join("changed_fields", ",").alias("changed_fields")


@query("diff_full", f"{CLASSIFIED} SELECT source, source_id, kind, changed_fields, new_source FROM classified")
def diff_full(t):
    return _classified(t).select("source", "source_id", "kind", joined(), "new_source")


@query("diff_summary", f"{CLASSIFIED} SELECT kind, new_source, count(*) AS n FROM classified GROUP BY 1, 2")
def diff_summary(t):
    return D.summary(_classified(t))


@query("diff_review", f"{CLASSIFIED} SELECT source, source_id, kind, changed_fields, CAST(CASE WHEN kind = 'NEW' AND NOT new_source THEN 1 WHEN kind = 'NEW' THEN 2 WHEN kind = 'CHANGED' THEN 3 ELSE 4 END AS INTEGER) AS rank FROM classified WHERE kind IN ('NEW', 'CHANGED', 'NEEDS_REHASH')")
def diff_review(t):
    return D.review(_classified(t)).select("source", "source_id", "kind", joined(), "rank")


@query(
    "diff_wrapper",
    f"{CLASSIFIED} SELECT d.kind, d.kind AS diff_status, d.changed_fields, d.source AS record_source, d.source_id AS record_source_id, coalesce(c.title, p.title) AS record_title, CASE WHEN d.kind = 'GONE' THEN p.content_hash ELSE c.content_hash END AS record_content_hash, CASE WHEN d.kind = 'GONE' THEN p.hash_version ELSE c.hash_version END AS record_hash_version FROM classified d LEFT JOIN curr c ON d.source = c.source AND d.source_id = c.source_id LEFT JOIN prev p ON d.source = p.source AND d.source_id = p.source_id",
)
def diff_wrapper(t):
    prev, curr = snapshots(t("documents"))
    r = lambda c: F.col(f"record.{c}").alias(f"record_{c}")
    return D.wrapped(D.classify(prev, curr), prev, curr).select("kind", "diff_status", joined(), *map(r, ("source", "source_id", "title", "content_hash", "hash_version")))


@query("diff_new", f"WITH {SNAPSHOTS} SELECT source, source_id, title FROM curr c WHERE source IN (SELECT source FROM prev) AND NOT EXISTS (SELECT 1 FROM prev p WHERE p.source = c.source AND p.source_id = c.source_id)")
def diff_new(t):
    return D.new(*snapshots(t("documents"))).select("source", "source_id", "title")


@query("diff_gone", f"WITH {SNAPSHOTS} SELECT source, source_id, title FROM prev p WHERE source IN (SELECT source FROM curr) AND NOT EXISTS (SELECT 1 FROM curr c WHERE p.source = c.source AND p.source_id = c.source_id)")
def diff_gone(t):
    return D.gone(*snapshots(t("documents"))).select("source", "source_id", "title")


@query("diff_changed", f"{CLASSIFIED} SELECT source, source_id, changed_fields FROM classified WHERE kind = 'CHANGED'")
def diff_changed(t):
    return D.changed(*snapshots(t("documents"))).select("source", "source_id", joined())


@query("common_sources", f"WITH {SNAPSHOTS} SELECT source FROM prev INTERSECT SELECT source FROM curr")
def common_sources(t):
    return D.common_sources(*snapshots(t("documents")))


@query("added_sources", f"WITH {SNAPSHOTS} SELECT source FROM curr EXCEPT SELECT source FROM prev")
def added_sources(t):
    return D.added_sources(*snapshots(t("documents")))


@query("dropped_sources", f"WITH {SNAPSHOTS} SELECT source FROM prev EXCEPT SELECT source FROM curr")
def dropped_sources(t):
    return D.dropped_sources(*snapshots(t("documents")))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t):
    return duplicate_keys(t("lineitem"), "l_orderkey", "l_linenumber")


@query("load_guard", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated, count(*) FILTER (WHERE n > 1) = 0 AND sum(n) > 0 AS ok FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def load_guard(t):
    keys = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), ((F.count_if(F.col("n") > 1) == 0) & (F.sum("n") > 0)).alias("ok"))

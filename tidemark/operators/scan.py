"""Scan control over landed pages: what was new on a page, when a scan stops, and how complete it was.

Every rule looks at pages of one source in order, so windows partition by source over page-level rows, which
are few; row-level work is grouped by (source, id) or (source, page).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STOP_AFTER, STOP_AFTER_CLOSED, LEAST = 2, 8, 50


def with_new_flags(rows: DataFrame) -> DataFrame:
    """is_new: the id was on no earlier page. A repeat within one page is as new as its first."""
    first = Window.partitionBy("source", "id")
    return rows.withColumn("is_new", F.min("page_no").over(first) == F.col("page_no"))


def streak(pages: DataFrame, hit: str, name: str) -> DataFrame:
    """pages with the length of the run of pages up to here on which `hit` is zero."""
    order = Window.partitionBy("source").orderBy("page_no")
    marked = pages.withColumn("__run", F.sum(F.when(F.col(hit) > 0, 1).otherwise(0)).over(order))
    run = Window.partitionBy("source", "__run").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(F.when(F.col(hit) > 0, 0).otherwise(1)).over(run)).drop("__run")


def page_stats(rows: DataFrame) -> DataFrame:
    """source, page_no, n_rows, n_new, no_new_streak."""
    pages = with_new_flags(rows).groupBy("source", "page_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_new").alias("n_new"))
    return streak(pages, "n_new", "no_new_streak")


def stops(stats: DataFrame, max_pages: int | None = None) -> DataFrame:
    """source, stop_page, stop_reason, last_new: the first page that ends the scan, and why."""
    ended = stats.withColumn("why", F.when((F.col("n_rows") == 0) & (F.col("page_no") == 1), "parse-failure").when(F.col("n_rows") == 0, "reached-total").when(F.col("no_new_streak") >= STOP_AFTER, "no-new-2pages"))
    if max_pages is not None:
        ended = ended.withColumn("why", F.when(F.col("why").isNull() & (F.col("page_no") >= max_pages), "page-cap").otherwise(F.col("why")))
    return ended.groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("why").isNotNull(), F.col("page_no"))), F.max("page_no")).alias("stop_page"),
        F.coalesce(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("page_no"))), F.lit("reached-total")).alias("stop_reason"),
        F.min_by("n_new", F.when(F.col("why").isNotNull(), F.col("page_no"))).alias("last_new"),
    )


def crawl_stats(rows: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row a source: stop_page, stop_reason, pages_fetched, collected, duplicates (rows seen on an earlier
    page), within the pages up to the stop."""
    end = stops(page_stats(rows), max_pages)
    held = with_new_flags(rows).join(end, "source").where(F.col("page_no") <= F.col("stop_page"))
    return held.groupBy("source", "stop_page", "stop_reason", "last_new").agg(F.count_distinct("page_no").alias("pages_fetched"), F.count_distinct("id").alias("collected"), F.count_if(~F.col("is_new")).alias("duplicates"))


#: Answers that mean a refusal, which is never worked around.
REFUSED = (401, 403)
PAGE_COLUMNS = {"kind": "string", "status": "int", "error": "string", "blocked": "boolean", "has_more": "boolean", "max_pages": "long"}


def controlled(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Where and why each source's scan stops, from all that was asked for: pages (source, page_no and, where known,
    status, error, blocked, has_more, max_pages, and kind: main, which tells failures apart, or other) and
    the rows found on them (source, page_no, id). One row a source: stop_page, stop_reason, pages_fetched,
    collected, duplicates, last_new.

    A page that isn't there ends the scan like a failed one; after the last page that is, the cap is taken for
    reached. What a refused or unreadable scan found isn't kept."""
    own = pages.select("source", F.col("page_no").cast("long").alias("page_no"), *((F.col(c) if c in pages.columns else F.lit(None)).cast(t).alias(c) for c, t in PAGE_COLUMNS.items()))
    flagged = with_new_flags(rows.select("source", F.col("page_no").cast("long").alias("page_no"), "id"))
    found = flagged.groupBy("source", "page_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_new").alias("n_new"))
    order = Window.partitionBy("source").orderBy("page_no")
    placed = own.join(found, ["source", "page_no"], "left").withColumn("__place", F.row_number().over(order).cast("long"))
    there = lambda c: F.when(F.col("page_no") == F.col("__place"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0))
    met = streak(placed.withColumns({c: there(c) for c in ("n_rows", "n_new")}), "n_new", "no_new_streak")
    main = F.coalesce(F.col("kind"), F.lit("main")) == "main"
    named = lambda reason: F.when(main, reason).otherwise(F.lit("error"))
    why = (
        F.when(F.col("page_no") != F.col("__place"), named(F.lit("network-error")))
        .when(F.col("status").isin(*REFUSED) | F.col("blocked"), "blocked")
        .when(F.col("error").isNotNull(), named(F.lit("network-error")))
        .when(F.col("status") != 200, named(F.concat(F.lit("http-"), F.col("status").cast("string"))))
        .when((F.col("n_rows") == 0) & (F.col("page_no") == 1), named(F.lit("parse-failure")))
        .when((F.col("n_rows") == 0) | ~F.coalesce("has_more", F.lit(True)), "reached-total")
        .when(F.col("no_new_streak") >= STOP_AFTER, "no-new-2pages")
        .when((F.col("page_no") >= F.col("max_pages")) | F.lead("page_no").over(order).isNull(), "page-cap")
    )
    judged = met.withColumn("why", why).withColumn("stopped", F.min(F.when(F.col("why").isNotNull(), F.col("page_no"))).over(Window.partitionBy("source")))
    held = judged.where(F.col("page_no") <= F.col("stopped"))
    at_stop = lambda c: F.max(F.when(F.col("page_no") == F.col("stopped"), F.col(c)))
    answered = F.coalesce(F.col("status"), F.lit(200)) == 200
    ends = held.groupBy("source").agg(
        at_stop("__place").alias("stop_page"),
        at_stop("why").alias("stop_reason"),
        F.coalesce(F.max(F.when(answered & F.col("error").isNull() & ~F.coalesce("blocked", F.lit(False)) & (F.col("page_no") == F.col("__place")), F.col("page_no"))), F.lit(0)).alias("pages_fetched"),
        F.coalesce(F.sum("n_new"), F.lit(0)).alias("collected"),
        (F.sum("n_rows") - F.sum("n_new")).alias("duplicates"),
        at_stop("n_new").alias("last_new"),
    )
    return ends.withColumn("collected", F.when(F.col("stop_reason").isin("blocked", "parse-failure"), F.lit(0)).otherwise(F.col("collected")))


def api_outcome(pages: DataFrame, per_page: int = 100) -> DataFrame:
    """How an API scan ends, from pages (source, page_no, status, error, blocked, n_rows, n_open, total): one row a
    source with stop_page and stop_reason: blocked; api (every row seen); api-window (given up after closed
    pages); or null where nothing is proven and the listed pages have to be scanned instead (another failure, a
    page missing, a total that changed, a short or empty page before the total, or no end at all)."""
    known = api_proof(pages, per_page)
    order = Window.partitionBy("source").orderBy("page_no")
    why = (
        F.when(F.col("page_no") != F.row_number().over(order), "fallback")
        .when(F.col("status").isin(*REFUSED) | F.coalesce("blocked", F.lit(False)), "blocked")
        .when(F.col("error").isNotNull() | (F.coalesce("status", F.lit(200)) != 200) | F.col("total_changed") | F.col("total").isNull(), "fallback")
        .when(F.col("proven"), "api")
        .when(F.col("n_rows") < per_page, "fallback")
        .when(F.col("stopped"), "api-window")
        .when(F.lead("page_no").over(order).isNull(), "fallback")
    )
    judged = known.withColumn("why", why).where("why is not null")
    return judged.groupBy("source").agg(F.min("page_no").alias("stop_page"), F.nullif(F.min_by("why", "page_no"), F.lit("fallback")).alias("stop_reason"))


def coverage(stats: DataFrame, least: int = LEAST, smoke: bool = False) -> DataFrame:
    """crawl_stats with status and exit_code."""
    partial = F.col("stop_reason").isin("parse-failure", "network-error", "error", "api-window") | F.startswith(F.col("stop_reason"), F.lit("http-"))
    if not smoke:
        partial = partial | ((F.col("stop_reason") == "page-cap") & (F.coalesce("last_new", F.lit(0)) > 0)) | (F.col("collected") < least)
    status = F.when(F.col("stop_reason") == "blocked", "manual").when(partial, "partial").otherwise("ok")
    return stats.withColumn("status", status).withColumn("exit_code", F.when(status == "ok", 0).when(status == "partial", 2).otherwise(3))


def dedup(rows: DataFrame, key: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row a key: the first or the last in the order, which should be total."""
    by = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n")


def api_proof(pages: DataFrame, per_page: int = 100) -> DataFrame:
    """pages (source, page_no, n_rows, n_open, total) with what the scan knows after each: scanned, whether the
    total changed, the run of closed pages, proven (all rows seen) and stopped (given up on newest-first pages)."""
    order = Window.partitionBy("source").orderBy("page_no")
    known = streak(pages, "n_open", "zero_open_streak")
    return known.select(
        "*",
        ((F.col("page_no") - 1) * per_page + F.col("n_rows")).alias("scanned"),
        F.coalesce(F.lag("total").over(order) != F.col("total"), F.lit(False)).alias("total_changed"),
    ).select("*", (F.col("scanned") >= F.col("total")).alias("proven"), ((F.col("zero_open_streak") >= STOP_AFTER_CLOSED) & (F.sum("n_open").over(order) > 0)).alias("stopped"))

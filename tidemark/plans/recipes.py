"""Inputs in the shapes of announcement data, derived from the star-schema tables: as DataFrames, and as the
same common table expressions in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two runs over documents: rows come, go, change title, hash or hash version; each side lacks a source."""
    d = F.col("doc_id")
    own = lambda n: F.when(d % n == 0, F.lit(None).cast("string"))
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    base = lambda title, digest, version: docs.select("doc_id", "source", d.cast("string").alias("source_id"), title.alias("title"), F.col("lang").alias("status"), digest.alias("content_hash"), version.cast("int").alias("hash_version"))
    head = F.substring("text", 1, 60)
    prev = base(head, own(19).otherwise(sha), F.lit(2)).where((d % 9 != 1) & (F.col("source") != "src19"))
    curr = base(F.concat(head, F.when(d % 11 == 0, " [rev]").otherwise("")), own(17).when(d % 23 == 0, F.sha2(F.encode(sha, "UTF-8"), 256)).otherwise(sha), F.when(d % 13 == 0, 3).otherwise(2)).where((d % 7 != 2) & (F.col("source") != "src18"))
    return prev.drop("doc_id"), curr.drop("doc_id")


SNAPSHOTS = """
prev AS (SELECT source, CAST(doc_id AS VARCHAR) AS source_id, substr(text, 1, 60) AS title, lang AS status,
    CASE WHEN doc_id % 19 = 0 THEN NULL ELSE sha256(text) END AS content_hash, CAST(2 AS INTEGER) AS hash_version
  FROM documents WHERE doc_id % 9 <> 1 AND source <> 'src19'),
curr AS (SELECT source, CAST(doc_id AS VARCHAR) AS source_id, substr(text, 1, 60) || CASE WHEN doc_id % 11 = 0 THEN ' [rev]' ELSE '' END AS title, lang AS status,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN sha256(sha256(text)) ELSE sha256(text) END AS content_hash,
    CAST(CASE WHEN doc_id % 13 = 0 THEN 3 ELSE 2 END AS INTEGER) AS hash_version
  FROM documents WHERE doc_id % 7 <> 2 AND source <> 'src18')"""

#: The comparison as SQL: listed differences, then kinds.
CLASSIFIED = f"""
WITH {SNAPSHOTS},
met AS (
  SELECT coalesce(p.source, c.source) AS source, coalesce(p.source_id, c.source_id) AS source_id, p.source IS NOT NULL AS p_here, c.source IS NOT NULL AS c_here,
    nullif(p.content_hash, '') AS ph, nullif(c.content_hash, '') AS ch, p.hash_version AS pv, c.hash_version AS cv,
    concat_ws(',', CASE WHEN nullif(p.title, '') IS DISTINCT FROM nullif(c.title, '') THEN 'title' END, CASE WHEN nullif(p.status, '') IS DISTINCT FROM nullif(c.status, '') THEN 'status' END,
      CASE WHEN nullif(p.content_hash, '') <> nullif(c.content_hash, '') AND p.hash_version IS NOT DISTINCT FROM c.hash_version THEN 'content_hash' END) AS listed
  FROM prev p FULL JOIN curr c ON p.source = c.source AND p.source_id = c.source_id),
classified AS (
  SELECT source, source_id,
    CASE WHEN NOT p_here THEN 'NEW' WHEN NOT c_here THEN 'GONE' WHEN listed <> '' OR (ph IS NOT NULL AND ch IS NOT NULL AND pv IS DISTINCT FROM cv) THEN 'CHANGED'
      WHEN ph IS NOT NULL AND ch IS NULL THEN 'NEEDS_REHASH' ELSE 'UNCHANGED' END AS kind,
    CASE WHEN NOT (p_here AND c_here) THEN '' WHEN listed <> '' THEN listed
      WHEN ph IS NOT NULL AND ch IS NOT NULL AND pv IS DISTINCT FROM cv THEN 'hash_version(산식 전환 — 1회 상세 재검증)' ELSE '' END AS changed_fields,
    source NOT IN (SELECT source FROM prev) AS new_source
  FROM met WHERE c_here OR source IN (SELECT source FROM curr))"""


def paged(docs: DataFrame) -> DataFrame:
    """A paged scan: 15 rows a page, ids that repeat after 600."""
    d = F.col("doc_id")
    return docs.select(F.lit("scan").alias("source"), F.expr("doc_id div 15 + 1").cast("long").alias("page_no"), (d % 15).alias("row_no"), (d % 600).alias("id"))


PAGED = """
scan AS (SELECT 'scan' AS source, doc_id // 15 + 1 AS page_no, doc_id % 15 AS row_no, doc_id % 600 AS id FROM documents),
flagged AS (SELECT *, min(page_no) OVER (PARTITION BY source, id) = page_no AS is_new FROM scan),
pages_ AS (SELECT source, page_no, count(*) AS n_rows, count(*) FILTER (WHERE is_new) AS n_new FROM flagged GROUP BY source, page_no),
runs AS (SELECT *, sum(CASE WHEN n_new > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page_no) AS run FROM pages_),
streaks AS (SELECT source, page_no, n_rows, n_new, CAST(sum(CASE WHEN n_new > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source, run ORDER BY page_no) AS BIGINT) AS no_new_streak FROM runs),
stop AS (SELECT source, coalesce(min(page_no) FILTER (WHERE no_new_streak >= 2), max(page_no)) AS stop_page, CASE WHEN max(no_new_streak) >= 2 THEN 'no-new-2pages' ELSE 'reached-total' END AS stop_reason FROM streaks GROUP BY source),
stats AS (SELECT f.source, s.stop_page, s.stop_reason, count(DISTINCT page_no) AS pages_fetched, count(DISTINCT id) AS collected, count(*) FILTER (WHERE NOT is_new) AS duplicates
  FROM flagged f JOIN stop s ON f.source = s.source WHERE page_no <= stop_page GROUP BY 1, 2, 3)"""


#: Sixteen scans of events, five rows a page, each ended in its own way (scan number: what its page is).
ENDS = """
 0: ids repeat from page 5 on          8: cap at page 3
 1: page 3 answers 403                 9: page 2 is the last of its source
 2: page 4 is a refusal in disguise   10: other source, page 3 answers 401
 3: page 5 fails on the network       11: other source, page 4 fails
 4: page 6 answers 500                12: other source, page 1 has no row
 5: page 1 has no row                 13: other source, page 5 says it is the last
 6: page 7 has no row                 14: other source, page 6 answers 404
 7: page 4 is missing                 15: cap at page 6, nothing new on pages 5 and 6 alike
"""


def scans(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and rows of the scans of ENDS."""
    k, n = F.col("event_id") % 16, F.expr("event_id div 16")
    rows = events.select(k.alias("k"), F.concat(F.lit("s"), k.cast("string")).alias("source"), F.expr("(event_id div 16) div 5 + 1").alias("page_no"), F.when(k.isin(0, 15), n % 20).otherwise(n).alias("id"))
    rows = rows.where((F.col("k") != 9) | (F.col("page_no") <= 2))
    pages = rows.groupBy("k", "source", "page_no").agg(F.lit(None).cast("string").alias("x")).drop("x").where("not (k = 7 and page_no = 4)")
    at = lambda scan, page: (F.col("k") == scan) & (F.col("page_no") == page)
    told = pages.select(
        "source",
        "page_no",
        F.when(F.col("k").between(10, 14), "other").otherwise("main").alias("kind"),
        F.when(at(1, 3), 403).when(at(4, 6), 500).when(at(10, 3), 401).when(at(14, 6), 404).when(at(3, 5) | at(11, 4), F.lit(None)).otherwise(200).alias("status"),
        F.when(at(3, 5) | at(11, 4), "reset by peer").alias("error"),
        at(2, 4).alias("blocked"),
        (~at(13, 5)).alias("has_more"),
        F.when(F.col("k") == 8, 3).when(F.col("k") == 15, 6).otherwise(40).cast("long").alias("max_pages"),
    )
    bad = at(1, 3) | at(2, 4) | at(3, 5) | at(4, 6) | at(5, 1) | at(6, 7) | at(7, 4) | at(10, 3) | at(11, 4) | at(12, 1) | at(14, 6)
    return told, rows.where(~bad).select("source", "page_no", "id")


#: The same ends worked out from the layout alone: what is collected when all pages are full.
SCAN_ENDS = """
r AS (SELECT event_id % 16 AS k, (event_id // 16) // 5 + 1 AS page_no, CASE WHEN event_id % 16 IN (0, 15) THEN (event_id // 16) % 20 ELSE event_id // 16 END AS id FROM events),
f AS (SELECT k, page_no, id, min(page_no) OVER (PARTITION BY k, id) AS first_page FROM r),
e(k, stop_page, stop_reason, read_to, status, fetched) AS (VALUES
  (0, 6, 'no-new-2pages', 6, 'ok', 6), (1, 3, 'blocked', 0, 'manual', 2), (2, 4, 'blocked', 0, 'manual', 3), (3, 5, 'network-error', 4, 'partial', 4),
  (4, 6, 'http-500', 5, 'partial', 5), (5, 1, 'parse-failure', 0, 'partial', 1), (6, 7, 'reached-total', 6, 'ok', 7), (7, 4, 'network-error', 3, 'partial', 3),
  (8, 3, 'page-cap', 3, 'partial', 3), (9, 2, 'page-cap', 2, 'partial', 2), (10, 3, 'blocked', 0, 'manual', 2), (11, 4, 'error', 3, 'partial', 3),
  (12, 1, 'error', 0, 'partial', 1), (13, 5, 'reached-total', 5, 'ok', 5), (14, 6, 'error', 5, 'partial', 5), (15, 6, 'no-new-2pages', 6, 'ok', 6)),
s AS (SELECT 's' || e.k AS source, e.stop_page, e.stop_reason, e.fetched AS pages_fetched, count(*) FILTER (WHERE page_no <= read_to AND first_page = page_no) AS collected, count(*) FILTER (WHERE page_no <= read_to AND first_page < page_no) AS duplicates, e.status
  FROM e JOIN f ON f.k = e.k GROUP BY ALL)"""


def dates(orders: DataFrame) -> DataFrame:
    """Order dates in the ways sites write them."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda p: F.date_format(day, p)
    raw = F.when(k % 6 == 0, f("yyyy-MM-dd")).when(k % 6 == 1, f("yyyy.M.d")).when(k % 6 == 2, f("yy.MM.dd")).when(k % 6 == 3, f("yyyyMMdd")).when(k % 6 == 4, f("yyyy/MM/dd HH:mm")).otherwise("상시 모집")
    end = F.date_format(F.date_add(day.cast("date"), 30), "yyyy-MM-dd")
    sign = F.when(k % 4 == 0, "~").when(k % 4 == 1, "∼").when(k % 4 == 2, "～")
    period = F.when(sign.isNull(), f("yyyy.MM.dd")).otherwise(F.concat(f("yyyy.MM.dd"), F.lit(" "), sign, F.lit(" "), end))
    return orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", raw.alias("raw"), end.alias("end_date"), period.alias("period"))


DATES = """
dates AS (SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus,
  CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate)
    WHEN 2 THEN strftime(o_orderdate, '%y.%m.%d') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M') ELSE '상시 모집' END AS raw,
  strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS end_date,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y.%m.%d') || ' ~ ' || strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') || ' ∼ ' || strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d')
    WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d') || ' ～ ' || strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%Y.%m.%d') END AS period
  FROM orders)"""


def table_rows(orders: DataFrame) -> DataFrame:
    """A list page a hundred orders: table rows of key, priority, period and status."""
    d = dates(orders)
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td> "), F.col("o_orderpriority"), F.lit("</td>\n<td><b>"), F.col("period"), F.lit("</b></td><td>"), F.col("end_date"), F.lit("</td><td>"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.lit("</td></tr>"))
    paged_ = d.select(F.expr("o_orderkey div 100").alias("page_no"), F.col("o_orderkey"), row.alias("row"))
    return paged_.groupBy("page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), "").alias("html"))


#: The same rows, as cells, without the page around them.
CELLS = f"""
WITH {DATES},
cells AS (SELECT o_orderkey // 100 AS page_no, CAST(row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS INTEGER) AS row_no,
  [CAST(o_orderkey AS VARCHAR), o_orderpriority, period, end_date, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END] AS c FROM dates)"""


def attachments(conversations: DataFrame) -> DataFrame:
    """Details from conversations: the first turn is the body, later turns are attachments with a state."""
    state = F.when((F.col("conv_id") + F.col("turn")) % 5 < 3, "ok").when((F.col("conv_id") + F.col("turn")) % 5 == 3, "failed").otherwise("skipped_robots")
    rows = conversations.withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("state", state)
    later = F.col("turn") > 0
    return rows.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("body"), F.collect_list(F.when(later, F.col("sha"))).alias("hashes"), F.collect_list(F.when(later, F.col("state"))).alias("states"))


DETAILS = """
att AS (SELECT *, sha256(text) AS sha, CASE WHEN (conv_id + turn) % 5 < 3 THEN 'ok' WHEN (conv_id + turn) % 5 = 3 THEN 'failed' ELSE 'skipped_robots' END AS state FROM conversations),
details AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS body, coalesce(string_agg(sha, chr(10) ORDER BY sha) FILTER (WHERE turn > 0), '') AS hashes,
  count(*) FILTER (WHERE turn > 0) AS n, count(*) FILTER (WHERE turn > 0 AND state <> 'ok') AS n_bad FROM att GROUP BY conv_id)"""


def api_rows(orders: DataFrame) -> DataFrame:
    """API rows from orders, a hundred a page."""
    k = F.col("o_orderkey")
    return orders.select(
        F.expr("o_orderkey div 100 + 1").alias("page_no"),
        k.alias("pbanc_sn"),
        F.when(k % 7 == 0, "   ").otherwise(F.col("o_orderpriority")).alias("supt_biz_clsfc"),
        F.col("o_orderstatus").alias("biz_enyy"),
        F.concat(F.lit(" order "), k.cast("string")).alias("biz_pbanc_nm"),
        F.col("o_custkey").cast("string").alias("pbanc_ntrp_nm"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("pbanc_rcpt_bgng_dt"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyyMMdd").alias("pbanc_rcpt_end_dt"),
        F.when(F.col("o_orderstatus") == "F", "N").otherwise("Y").alias("rcrt_prgs_yn"),
        F.when(k % 5 == 0, F.concat(F.lit("https://www.k-startup.go.kr/x/"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("http://www.k-startup.go.kr/x/"), k.cast("string"))).otherwise("https://k-startup.go.kr.example.com/").alias("detl_pg_url"),
    )


TODAY = "1998-01-01"
API = f"""
api AS (SELECT o_orderkey // 100 + 1 AS page_no, *, strftime(o_orderdate, '%Y-%m-%d') AS start_, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS end_,
  o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) + 30 >= DATE '{TODAY}' AS is_open FROM orders)"""

"""Queries of scan control, dedup, API scans and manifests."""

from pyspark.sql import functions as F

from ..operators import manifest as M
from ..operators import scan as S
from ..sources import api as A
from .recipes import API, PAGED, SCAN_ENDS, TODAY, api_rows, paged, scans
from .registry import query

ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
KEPT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_DEDUP = "SELECT {k} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {o}) AS n FROM lineitem) WHERE n = 1"


@query("dedup_last", _DEDUP.format(k=", ".join(KEPT), o=", ".join(f"{c} DESC" for c in ORDER)))
def dedup_last(t):
    return S.dedup(t("lineitem"), ["l_orderkey", "l_linenumber"], ORDER, "last").select(KEPT)


@query("dedup_first", _DEDUP.format(k=", ".join(KEPT), o=", ".join(ORDER)))
def dedup_first(t):
    return S.dedup(t("lineitem"), ["l_orderkey", "l_linenumber"], ORDER, "first").select(KEPT)


@query("page_new_flags", f"WITH {PAGED} SELECT page_no, row_no, id, is_new FROM flagged")
def page_new_flags(t):
    return S.with_new_flags(paged(t("documents"))).select("page_no", "row_no", "id", "is_new")


@query("no_new_streak", f"WITH {PAGED} SELECT * FROM streaks")
def no_new_streak(t):
    return S.page_stats(paged(t("documents"))).select("source", "page_no", "n_rows", "n_new", "no_new_streak")


@query("crawl_stats", f"WITH {PAGED} SELECT * FROM stats")
def crawl_stats(t):
    return S.crawl_stats(paged(t("documents"))).drop("last_new")


@query("coverage_status", f"WITH {PAGED} SELECT source, stop_reason, collected, CASE WHEN collected < 50 THEN 'partial' ELSE 'ok' END AS status, CAST(CASE WHEN collected < 50 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM stats")
def coverage_status(t):
    return S.coverage(S.crawl_stats(paged(t("documents")))).select("source", "stop_reason", "collected", "status", "exit_code")


@query("stop_reasons", f"WITH {SCAN_ENDS} SELECT source, CAST(stop_page AS BIGINT) AS stop_page, stop_reason, CAST(pages_fetched AS BIGINT) AS pages_fetched, collected, duplicates, status, CAST(CASE status WHEN 'ok' THEN 0 WHEN 'partial' THEN 2 ELSE 3 END AS INTEGER) AS exit_code FROM s")
def stop_reasons(t):
    made = S.coverage(S.controlled(*scans(t("events"))), least=1)
    return made.select("source", "stop_page", "stop_reason", "pages_fetched", "collected", F.when(F.col("stop_reason") == "blocked", 0).otherwise(F.col("duplicates")).cast("long").alias("duplicates"), "status", "exit_code")


@query(
    "api_outcomes",
    "WITH a AS (SELECT 'a' || (o_orderkey % 8) AS source, count(*) AS total, count(*) // 10 AS whole FROM orders GROUP BY 1) SELECT source, CAST(CASE source WHEN 'a0' THEN CASE WHEN total % 10 > 0 THEN whole + 1 ELSE whole END WHEN 'a1' THEN 3 WHEN 'a2' THEN 2 WHEN 'a3' THEN 9 WHEN 'a4' THEN 4 WHEN 'a5' THEN 3 WHEN 'a6' THEN 5 ELSE 2 END AS BIGINT) AS stop_page, CASE source WHEN 'a0' THEN 'api' WHEN 'a1' THEN 'blocked' WHEN 'a2' THEN 'blocked' WHEN 'a3' THEN 'api-window' END AS stop_reason FROM a",
)
def api_outcomes(t):
    """Eight API scans of ten rows a page: all seen; 403; disguised; eight closed pages after an open one; total
    changes; a page missing; an empty page; an error."""
    from pyspark.sql import Window

    own = t("orders").select(F.concat(F.lit("a"), (F.col("o_orderkey") % 8).cast("string")).alias("source"), (F.row_number().over(Window.partitionBy(F.col("o_orderkey") % 8).orderBy("o_orderkey")) - 1).alias("n"))
    pages = own.groupBy("source", F.expr("n div 10 + 1").alias("page_no")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = own.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    at = lambda s, p: (F.col("source") == s) & (F.col("page_no") == p)
    told = pages.join(total, "source").where(~at("a5", 2)).select(
        "source",
        "page_no",
        F.when(at("a6", 5), 0).otherwise(F.col("n_rows")).alias("n_rows"),
        F.when((F.col("source") == "a3") & (F.col("page_no") > 1), 0).otherwise(5).alias("n_open"),
        (F.col("total") + F.when((F.col("source") == "a4") & (F.col("page_no") > 3), 1).otherwise(0)).alias("total"),
        F.when(at("a1", 3), 403).otherwise(200).alias("status"),
        F.when(at("a7", 2), "timeout").alias("error"),
        at("a2", 2).alias("blocked"),
    )
    return S.api_outcome(told, 10)


def _today():
    return F.to_date(F.lit(TODAY))


@query(
    "api_normalize",
    f"WITH {API} SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE o_orderpriority END AS category, CASE WHEN CAST(end_ AS DATE) >= DATE '{TODAY}' THEN 'D-' || (CAST(end_ AS DATE) - DATE '{TODAY}') ELSE '' END AS dday, 'order ' || o_orderkey AS title, CAST(o_custkey AS VARCHAR) AS org, start_ AS apply_start, end_ AS apply_end, CASE WHEN o_orderkey % 5 = 0 THEN 'https://www.k-startup.go.kr/x/' || o_orderkey ELSE 'https://www.k-startup.go.kr/web/contents/bizpbanc-ongoing.do?schM=view&pbancSn=' || o_orderkey END AS url, is_open FROM api",
)
def api_normalize(t):
    return A.normalise(api_rows(t("orders")), _today()).drop("source", "program", "agency_type")


@query("coalesce_pick", "SELECT o_orderkey AS pbanc_sn, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE o_orderpriority END AS category FROM orders")
def coalesce_pick(t):
    from ..functions.text import coalesce_pick as pick

    return api_rows(t("orders")).select("pbanc_sn", pick(F.col("supt_biz_clsfc"), F.col("biz_enyy")).alias("category"))


@query("open_filter", f"WITH {API} SELECT o_orderkey AS pbanc_sn FROM api WHERE is_open")
def open_filter(t):
    from ..functions.text import is_open

    return api_rows(t("orders")).where(is_open(F.col("rcrt_prgs_yn"), F.col("pbanc_rcpt_end_dt"), _today())).select("pbanc_sn")


def _pages(t):
    from ..functions.text import is_open

    rows = api_rows(t("orders")).withColumn("open", is_open(F.col("rcrt_prgs_yn"), F.col("pbanc_rcpt_end_dt"), _today()) & (F.col("page_no") % 20 < 9))
    pages = rows.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("open").alias("n_open"))
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("source", F.lit("api"))
    return pages.withColumn("source", F.lit("api")).join(total, "source")


_API_PAGES = f"""WITH {API},
p AS (SELECT page_no, count(*) AS n_rows, count(*) FILTER (WHERE is_open AND page_no % 20 < 9) AS n_open FROM api GROUP BY page_no),
r AS (SELECT *, sum(CASE WHEN n_open > 0 THEN 1 ELSE 0 END) OVER (ORDER BY page_no) AS run, sum(n_open) OVER (ORDER BY page_no) AS seen, (SELECT count(*) FROM api) AS total FROM p),
s AS (SELECT *, CAST(sum(CASE WHEN n_open > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY page_no) AS BIGINT) AS zero_open_streak FROM r)"""


@query("zero_open_streak", f"{_API_PAGES} SELECT page_no, n_open, zero_open_streak FROM s")
def zero_open_streak(t):
    return S.streak(_pages(t), "n_open", "zero_open_streak").select("page_no", "n_open", "zero_open_streak")


@query("api_scan_proof", f"{_API_PAGES} SELECT page_no, n_rows, (page_no - 1) * 100 + n_rows AS scanned, false AS total_changed, (page_no - 1) * 100 + n_rows >= total AS proven, zero_open_streak >= 8 AND seen > 0 AS stopped FROM s")
def api_scan_proof(t):
    return S.api_proof(_pages(t)).select("page_no", "n_rows", "scanned", "total_changed", "proven", "stopped")


#: One payload an event, in the envelopes that are known and in two that aren't.
def _payloads(events):
    k, p = F.col("event_id"), F.col("props")
    made = F.when(k % 7 == 0, F.concat(F.lit('{"totalCount":'), k.cast("string"), F.lit(',"data":['), p, F.lit(","), p, F.lit("]}")))
    for n, (head, tail) in enumerate((('{"matchCount":"12","items":[', ',3]}'), ('{"response":{"header":{"resultCode":"00"},"body":{"totalCount":5,"items":{"item":[', "]}}}}"), ('{"response":{"body":{"items":{"item":', "}}}}"), ('{"error":"x","data":[', "]}"), ('{"response":{"header":{"resultCode":"99"},"body":{"items":{"item":[', "]}}}}")), 1):
        made = made.when(k % 7 == n, F.concat(F.lit(head), p, F.lit(tail)))
    return events.select("event_id", made.otherwise("{}").alias("payload"))


@query(
    "api_envelope",
    "SELECT event_id, event_id % 7 < 4 AS known, CASE event_id % 7 WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 2 THEN '1' WHEN 3 THEN '1' END AS n_records, CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '12' WHEN 2 THEN '5' END AS total FROM events",
)
def api_envelope(t):
    p = F.col("payload")
    return _payloads(t("events")).select("event_id", A.container(p).isNotNull().alias("known"), F.when(A.container(p).isNotNull(), F.size(A.records(p)).cast("string")).alias("n_records"), A.total(p).cast("string").alias("total"))


_RUNS = """
o AS (SELECT event_type AS source, count(*) AS collected, max(event_id) AS last_id FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'error' GROUP BY 1),
n AS (SELECT event_type AS source, count(*) AS collected, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'view' GROUP BY 1)"""


@query("manifest_upsert", f"WITH {_RUNS} SELECT * FROM o WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT * FROM n")
def manifest_upsert(t):
    half = F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    run = lambda rows: rows.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("collected"), F.max("event_id").alias("last_id"))
    events = t("events")
    return M.upsert(run(events.where((F.col("ts") < half) & (F.col("event_type") != "error"))), run(events.where((F.col("ts") >= half) & (F.col("event_type") != "view"))))


@query(
    "source_union",
    "SELECT 'kstartup' AS source, CAST(c_custkey AS VARCHAR) AS source_id, c_name AS title, c_mktsegment AS apply_start, '' AS apply_end FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), '' FROM supplier",
)
def source_union(t):
    from .. import schemas
    from ..sources.snapshot import unify

    main = t("customer").select(F.col("c_custkey").cast("string").alias("pbancSn"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("start"), F.lit("").alias("deadline"))
    other = t("supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("apply_start"), F.lit("").alias("apply_end"))
    empty = t("supplier").sparkSession.createDataFrame([], schemas.RAW)
    raw = empty.unionByName(main, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    return unify(raw).select("source", "source_id", "title", "apply_start", "apply_end")

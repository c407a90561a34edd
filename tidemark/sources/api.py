"""JSON list payloads: envelopes, totals, and rows in announcement form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U

#: Field names in order of preference.
FIELDS = {
    "id": ("pbanc_sn", "biz_pbanc_sn", "pbancSn"),
    "url": ("detl_pg_url", "pbanc_url", "pblancUrl", "url"),
    "end": ("pbanc_rcpt_end_dt", "pbanc_end_dt", "rcpt_end_dt"),
    "start": ("pbanc_rcpt_bgng_dt", "rcpt_bgng_dt", "pbanc_bgng_dt"),
    "category": ("supt_biz_clsfc", "intg_pbanc_biz_nm", "biz_enyy"),
    "title": ("biz_pbanc_nm", "pbanc_nm", "pbancNm"),
    "org": ("pbanc_ntrp_nm", "sprv_inst", "biz_prch_dprt_nm"),
    "progress": ("rcrt_prgs_yn", "pbanc_prgs_yn"),
}
ERRORS = ("error", "errMsg", "reqErr", "errorMessage")
HOSTS = ("=www.k-startup.go.kr", "=k-startup.go.kr")
DETAIL = "https://www.k-startup.go.kr/web/contents/bizpbanc-ongoing.do?schM=view&pbancSn="


def container(payload: Column) -> Column:
    """The records as JSON text in an array, or null where no known envelope holds any: data[], items[], or
    response.body.items as a list, its item list, or a single item."""
    get = lambda p: F.get_json_object(payload, p)
    is_list = lambda c: F.startswith(F.ltrim(c), F.lit("["))
    failed = F.lit(False)
    for name in ERRORS:
        failed = failed | F.array_contains(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), name)
    code = F.trim(F.coalesce(get("$.response.header.resultCode"), F.lit("")))
    items, item = get("$.response.body.items"), get("$.response.body.items.item")
    single = F.when(is_list(item), item).when(item.isNotNull(), F.concat(F.lit("["), item, F.lit("]"))).when(F.startswith(F.ltrim(items), F.lit("{")), F.lit("[]"))
    legacy = F.when(code.isin("", "00", "0"), F.when(is_list(items), items).otherwise(single))
    return F.when(~failed, F.coalesce(F.when(is_list(get("$.data")), get("$.data")), F.when(is_list(get("$.items")), get("$.items")), legacy))


def records(payload: Column) -> Column:
    """The objects among the records, as JSON texts; null for an unknown envelope."""
    return F.filter(F.from_json(container(payload), "array<string>"), lambda r: F.startswith(F.ltrim(r), F.lit("{")))


def total(payload: Column) -> Column:
    """totalCount, then matchCount, at the top and then in the legacy body; digits only."""
    paths = ("$.totalCount", "$.matchCount", "$.response.body.totalCount", "$.response.body.matchCount")
    number = lambda c: F.when(F.regexp_like(c, F.lit("^-?[0-9]+$")), F.try_to_number(c, F.lit("S" + "9" * 18)).cast("long"))
    return F.coalesce(*(number(F.get_json_object(payload, p)) for p in paths))


def normalise(rows: DataFrame, today: Column) -> DataFrame:
    """API rows in announcement form; rows without an id go, foreign or plain-http links are rebuilt."""
    pick = lambda name: X.coalesce_pick(*(F.col(c) for c in FIELDS[name] if c in rows.columns))
    end = X.norm_date(pick("end"), "api")
    link = pick("url")
    return rows.select(
        F.lit("kstartup").alias("source"),
        pick("id").alias("source_id"),
        pick("category").alias("category"),
        X.dday(end, today).alias("dday"),
        pick("title").alias("title"),
        F.lit("").alias("program"),
        pick("org").alias("org"),
        X.norm_date(pick("start"), "api").alias("apply_start"),
        end.alias("apply_end"),
        F.lit("").alias("agency_type"),
        F.when(U.host_allowed(link, HOSTS), link).otherwise(F.concat(F.lit(DETAIL), pick("id"))).alias("url"),
        X.is_open(pick("progress"), pick("end"), today).alias("is_open"),
    ).where("source_id <> ''")

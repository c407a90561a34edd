"""Queries of dates, periods, deadlines and their order."""

from pyspark.sql import functions as F

from ..functions import text as X
from .recipes import DATES, TODAY, dates
from .registry import query

_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_DAYS = f"(CAST(end_date AS DATE) - DATE '{TODAY}')"


@query("norm_date", f"WITH {DATES} SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (3, 5) THEN raw WHEN o_orderkey % 6 = 2 THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE {_ISO} END AS day FROM dates")
def norm_date(t):
    return dates(t("orders")).select("o_orderkey", X.norm_date(F.col("raw")).alias("day"))


@query("norm_date_api", f"WITH {DATES} SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 5) THEN raw ELSE {_ISO} END AS day FROM dates")
def norm_date_api(t):
    return dates(t("orders")).select("o_orderkey", X.norm_date(F.col("raw"), "api").alias("day"))


@query("split_period", f"WITH {DATES} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE {_ISO} END AS apply_start, CASE WHEN o_orderkey % 4 = 3 THEN {_ISO} ELSE end_date END AS apply_end FROM dates")
def split_period(t):
    start, end = X.split_period(F.col("period"))
    return dates(t("orders")).select("o_orderkey", start.alias("apply_start"), end.alias("apply_end"))


@query("dday", f"WITH {DATES} SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 AND {_DAYS} >= 0 THEN 'D-' || {_DAYS} ELSE '' END AS dday FROM dates")
def dday(t):
    end = F.when(F.col("o_orderkey") % 6 == 5, F.col("raw")).otherwise(F.col("end_date"))
    return dates(t("orders")).select("o_orderkey", X.dday(end, F.to_date(F.lit(TODAY))).alias("dday"))


def _ends(t):
    k = F.col("o_orderkey")
    return dates(t("orders")).select("o_orderkey", "o_orderpriority", F.when(k % 6 == 5, F.col("raw")).when(k % 6 == 4, "").otherwise(F.col("end_date")).alias("apply_end"))


_ENDS = f"WITH {DATES}, ends AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 6 WHEN 5 THEN raw WHEN 4 THEN '' ELSE end_date END AS apply_end FROM dates)"


@query("sort_deadline", f"{_ENDS} SELECT o_orderpriority, apply_end, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY coalesce(nullif(apply_end, ''), '~'), o_orderkey) AS INTEGER) AS place FROM ends")
def sort_deadline(t):
    """Missing ends sort as '~': after dates, before free text. Numbered within a priority."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_orderpriority").orderBy(F.coalesce(F.nullif("apply_end", F.lit("")), F.lit("~")), "o_orderkey")
    return _ends(t).select("o_orderpriority", "apply_end", "o_orderkey", F.row_number().over(order).alias("place"))


@query("top_deadlines", f"{_ENDS} SELECT o_orderkey, apply_end, date_diff('day', DATE '{TODAY}', CAST(apply_end AS DATE)) AS days, date_diff('day', DATE '{TODAY}', CAST(apply_end AS DATE)) <= 3 AS imminent FROM ends WHERE o_orderkey % 6 < 4 AND apply_end >= '{TODAY}' ORDER BY apply_end, o_orderkey LIMIT 20")
def top_deadlines(t):
    """The twenty nearest deadlines: a top-k report."""
    days = F.date_diff(F.try_to_date("apply_end", "yyyy-MM-dd"), F.to_date(F.lit(TODAY))).cast("long")
    return _ends(t).select("o_orderkey", "apply_end", days.alias("days"), (days <= 3).alias("imminent")).where("days >= 0").orderBy("apply_end", "o_orderkey").limit(20)

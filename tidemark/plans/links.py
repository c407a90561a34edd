"""Queries of URL functions."""

from pyspark.sql import functions as F

from ..functions import urls as U
from .registry import query

ALLOWED = ("example.org", "=blog.tionsh.example.com")
DOMAINS = {"org": ("example.org",), "blog": ("=blog.tionsh.example.com",), "net": ("example.net",)}
PATTERNS = ("/en/1", "/*/2*.html$", "/de/", "/fr/*ref=x")
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_HTTPS = "starts_with(lower(url), 'https://')"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1)"


@query("host_allowed", f"SELECT page_id, {_HTTPS} AND ({_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org') OR {_HOST} = 'blog.tionsh.example.com') AS allowed FROM pages")
def host_allowed(t):
    return t("pages").select("page_id", U.host_allowed(F.col("url"), ALLOWED).alias("allowed"))


@query("source_of_url", f"SELECT page_id, CASE WHEN NOT {_HTTPS} THEN NULL WHEN ends_with({_HOST}, '.example.org') THEN 'org' WHEN {_HOST} = 'blog.tionsh.example.com' THEN 'blog' WHEN ends_with({_HOST}, '.example.net') THEN 'net' END AS source FROM pages")
def source_of_url(t):
    return t("pages").select("page_id", U.source_of_url(F.col("url"), DOMAINS).alias("source"))


@query("url_parts", f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages")
def url_parts(t):
    part = lambda p: F.try_parse_url("url", F.lit(p))
    return t("pages").select("page_id", part("PROTOCOL").alias("scheme"), U.host(F.col("url")).alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"))


@query("url_canonical", "SELECT page_id, url FROM pages")
def url_canonical(t):
    planted = F.regexp_replace("url", r"\?", ";jsessionid=AB12.node1?")
    return t("pages").select("page_id", U.canonical(planted).alias("url"))


@query("url_id", "SELECT page_id, nullif(regexp_extract(url, '/[a-z]{2}/(\\d+)', 1), '') AS id FROM pages")
def url_id(t):
    return t("pages").select("page_id", U.id_of(F.col("url"), r"/[a-z]{2}/(\d+)").alias("id"))


@query("url_slug", r"SELECT page_id, substr(regexp_replace(regexp_extract(url, '^[^:]*://(.*)$', 1), '[^a-zA-Z0-9_]+', '_', 'g'), 1, 80) || '_' || substr(sha1(url), 1, 8) AS slug FROM pages")
def url_slug(t):
    return t("pages").select("page_id", U.slug(F.col("url")).alias("slug"))


@query("robots_match", f"SELECT page_id, starts_with(p, '/en/1') OR regexp_matches(p, '^/.*/2.*\\.html$') OR starts_with(p, '/de/') OR regexp_matches(p, '^/fr/.*ref=x') AS blocked, NOT (starts_with(p, '/en/1') OR regexp_matches(p, '^/.*/2.*\\.html$') OR starts_with(p, '/de/') OR regexp_matches(p, '^/fr/.*ref=x')) AS allowed FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def robots_match(t):
    path = F.concat(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.coalesce(F.concat(F.lit("?"), F.try_parse_url("url", F.lit("QUERY"))), F.lit("")))
    return t("pages").select("page_id", U.path_matches(path, PATTERNS).alias("blocked"), U.robots_allowed(PATTERNS)(F.col("url")).alias("allowed"))


@query("redact", "SELECT page_id, replace(url, 'example', '<KEY>') AS url FROM pages")
def redact(t):
    return t("pages").select("page_id", U.redacted(F.col("url"), "example").alias("url"))

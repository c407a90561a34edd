"""Queries of detail enrichment, hashes and attachments."""

from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import text as X
from ..operators import enrich as E
from ..operators import manifest as M
from .recipes import DETAILS, attachments
from .registry import query

_V3 = "sha256(body || chr(10) || hashes)"


@query("content_hash_v2", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def content_hash_v2(t):
    return t("conversations").select("conv_id", "turn", X.body_hash(F.col("text")).alias("digest"))


@query("content_hash_v3", f"WITH {DETAILS} SELECT conv_id, {_V3} AS digest FROM details")
def content_hash_v3(t):
    return attachments(t("conversations")).select("conv_id", X.content_hash(F.col("body"), F.col("hashes")).alias("digest"))


@query("hash_version", f"WITH {DETAILS} SELECT conv_id, CASE WHEN n > 0 AND n_bad = 0 THEN {_V3} ELSE sha256(body) END AS content_hash, CAST(CASE WHEN n > 0 AND n_bad = 0 THEN 3 ELSE 2 END AS INTEGER) AS hash_version FROM details")
def hash_version(t):
    digest, version = E.versioned_hash(F.col("body"), F.col("hashes"), F.col("states"))
    return attachments(t("conversations")).select("conv_id", digest.alias("content_hash"), version.alias("hash_version"))


@query("attachments_complete", f"WITH {DETAILS} SELECT conv_id, n AS n_attachments, n_bad = 0 AS complete FROM details")
def attachments_complete(t):
    return attachments(t("conversations")).select("conv_id", F.size("states").cast("long").alias("n_attachments"), E.complete(F.col("states")).alias("complete"))


@query("attachment_status", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'skipped_unverified' WHEN turn % 5 = 4 THEN 'skipped_robots' WHEN (conv_id + turn) % 5 = 3 THEN 'failed' ELSE 'ok' END AS status FROM conversations")
def attachment_status(t):
    k = F.col("conv_id") + F.col("turn")
    return t("conversations").select("conv_id", "turn", E.attachment_status(F.when(k % 11 == 0, "skipped_unverified"), F.col("turn") % 5 == 4, F.when(k % 5 != 3, X.body_hash(F.col("text")))).alias("status"))


@query("failure_list", f"WITH {DETAILS}, bad AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM att WHERE state <> 'ok') SELECT conv_id, count(*) AS n_failed, string_agg(turn || ':' || state, ', ' ORDER BY turn) FILTER (WHERE k <= 5) AS failures FROM bad GROUP BY conv_id")
def failure_list(t):
    k = (F.col("conv_id") + F.col("turn")) % 5
    return E.failures(t("conversations").withColumn("state", F.when(k < 3, "ok").when(k == 3, "failed").otherwise("skipped_robots")), "conv_id", "turn", "state")


def _details(t):
    return t("labels").select("doc_id", F.concat(F.lit("h"), F.col("quality").cast("string")).alias("content_hash"), F.when(F.col("toxic") == 1, 3).otherwise(2).alias("hash_version"))


@query("merge_detail", "SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN sha256(d.text) ELSE 'h' || l.quality END AS content_hash, CAST(CASE WHEN l.doc_id IS NULL THEN 1 WHEN l.toxic = 1 THEN 3 ELSE 2 END AS INTEGER) AS hash_version, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_detail(t):
    rows = t("documents").select("doc_id", "source", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.lit(1).alias("hash_version"))
    return E.merge_detail(rows, _details(t), ["doc_id"], ["content_hash", "hash_version"])


@query("detail_enrich", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'h' || l.quality END AS content_hash, CASE WHEN l.toxic = 1 THEN '3' WHEN l.doc_id IS NOT NULL THEN '2' END AS hash_version FROM documents d LEFT JOIN labels l USING (doc_id)")
def detail_enrich(t):
    return E.merge_detail(t("documents").select("doc_id"), _details(t), ["doc_id"], ["content_hash", "hash_version"]).select("doc_id", "content_hash", F.col("hash_version").cast("string").alias("hash_version"))


@query("dependent_lookup", "WITH files AS (SELECT conv_id, turn FROM conversations WHERE turn > 0 AND conv_id % 4 <> 0) SELECT w.conv_id, CASE WHEN w.conv_id % 5 = 0 THEN 'failed' WHEN f.turn IS NOT NULL THEN 'listed' WHEN w.conv_id % 8 = 0 THEN 'empty' ELSE 'failed' END AS state, CASE WHEN w.conv_id % 5 <> 0 THEN CAST(f.turn AS VARCHAR) END AS file FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) w LEFT JOIN files f ON w.conv_id = f.conv_id AND w.conv_id % 5 <> 0")
def dependent_lookup(t):
    c = t("conversations")
    links = F.when((F.col("turn") > 0) & (F.col("conv_id") % 4 != 0), F.concat(F.lit("<a file="), F.col("turn").cast("string"), F.lit(">")))
    pages = c.groupBy("conv_id").agg(F.array_join(F.collect_list(links), "").alias("links")).select("conv_id", F.concat(F.col("links"), F.when(F.col("conv_id") % 8 == 0, E.EMPTY_LOOKUP).otherwise("")).alias("page")).where("conv_id % 5 <> 0")
    return E.dependent_lookup(c.where("turn = 0").select("conv_id").distinct(), pages, "conv_id", "page", r"file=(\d+)>")


@query("profile_map", "SELECT conv_id, role AS key, CAST(max(turn) AS VARCHAR) AS value FROM conversations GROUP BY 1, 2")
def profile_map(t):
    """One profile a conversation: a bullet a turn, keyed by role; the last of a role counts."""
    lines = t("conversations").select("conv_id", "turn", F.concat(F.lit("- "), F.col("role"), F.lit(": "), F.col("turn").cast("string")).alias("value"))
    found = lines.select("conv_id", "turn", F.trim(F.regexp_extract("value", "^-([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract("value", "^[^:]*:(.*)$", 1)).alias("value"))
    return found.groupBy("conv_id", "key").agg(F.max_by("value", "turn").alias("value"))


_JSON = "'{{\"대표자\": ' || coalesce('\"' || {0}.v0 || '\"', 'null') || ', \"지역 연고\": ' || coalesce('\"' || {0}.v1 || '\"', 'null') || ', \"창업 단계\": ' || coalesce('\"' || {0}.v2 || '\"', 'null') || ', \"필요한 것\": ' || coalesce('\"' || {0}.v3 || '\"', 'null') || '}}'"
_PROFILES = "p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS v0, CASE WHEN doc_id % 5 < 3 THEN source END AS v1, CASE WHEN doc_id % 7 < 2 THEN CAST(doc_id % 10 AS VARCHAR) END AS v2, CASE WHEN doc_id % 11 = 0 THEN 'x' END AS v3, doc_id % 13 <> 0 AS here FROM documents)"


@query(
    "profile_guard",
    f"WITH {_PROFILES}, f AS (SELECT o.doc_id, substr(sha256({_JSON.format('o')}), 1, 16) AS old, substr(sha256({_JSON.format('n')}), 1, 16) AS new, o.here AS oh, n.here AS nh, coalesce(o.v0, o.v1, o.v2, o.v3) IS NOT NULL AS ofilled, coalesce(n.v0, n.v1, n.v2, n.v3) IS NOT NULL AS nfilled FROM p o JOIN p n ON n.doc_id = o.doc_id + 105) SELECT doc_id, old, new, (NOT oh AND NOT nh) OR (oh AND nh AND ofilled AND nfilled AND old = new) AS carries_over FROM f",
)
def profile_guard(t):
    """The profile of each document against that of the one 105 further: fingerprints, and whether verdicts
    carry over."""
    d = F.col("doc_id")
    values = (F.when(d % 3 == 0, F.col("lang")), F.when(d % 5 < 3, F.col("source")), F.when(d % 7 < 2, (d % 10).cast("string")), F.when(d % 11 == 0, F.lit("x")))
    held = F.create_map(*(x for axis, v in zip(sorted(M.AXES), values) for x in (F.lit(axis), v)))
    own = t("documents").select("doc_id", F.when(d % 13 != 0, held).alias("old"), held.alias("fields"))
    after = own.select((d - 105).alias("doc_id"), F.col("old").alias("new"), F.col("fields").alias("new_fields"))
    met = own.join(after, "doc_id")
    return met.select("doc_id", M.fingerprint_of(F.col("fields")).alias("old"), M.fingerprint_of(F.col("new_fields")).alias("new"), M.carry_over(F.col("old"), F.col("new")).alias("carries_over"))


@query("safe_filename", r"SELECT doc_id, printf('%02d_', doc_id % 100) || CASE WHEN base = '' THEN 'attach' ELSE substr(regexp_replace(base, '[^a-zA-Z0-9_.\-\p{L}\p{M}\p{N}\p{Pc}()\[\] ]', '_', 'g'), 1, 120) END AS name FROM (SELECT doc_id, regexp_extract(replace(coalesce(text, ''), chr(92), '/'), '[^/]*$') AS base FROM documents)")
def safe_filename(t):
    return t("documents").select("doc_id", N.safe_filename(F.col("text"), (F.col("doc_id") % 100).cast("int")).alias("name"))


@query("safe_subdir", r"SELECT doc_id, coalesce(nullif(substr(regexp_replace(source || '/' || lang || ' ' || doc_id, '[^a-zA-Z0-9_.\-]', '_', 'g'), 1, 80), ''), '_') AS folder FROM documents")
def safe_subdir(t):
    return t("documents").select("doc_id", N.safe_subdir(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"))).alias("folder"))


@query("attachment_hash", "SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) <= 20000 THEN sha256(text) END AS sha256 FROM documents")
def attachment_hash(t):
    """Files up to a size cap are hashed; a larger one keeps its size and no hash."""
    content = F.encode("text", "UTF-8")
    n = F.octet_length("text").cast("long")
    return t("documents").select("doc_id", n.alias("n_bytes"), F.when(n <= 20000, F.sha2(content, 256)).alias("sha256"))


#: How servers send a file name: as it is, with its references escaped twice, percent-encoded, or as bytes of an
#: encoding read as Latin-1.
_TITLE = "regexp_replace(text, '[^a-zA-Z0-9 ]', '_', 'g')"


@query("filename_recover", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {_TITLE} || '.hwp' WHEN 1 THEN {_TITLE} || '&.hwp' WHEN 2 THEN {_TITLE} || ' .hwp' WHEN 3 THEN {_TITLE} || '·.hwp' ELSE {_TITLE} || '공고문.hwp' END AS name FROM documents")
def filename_recover(t):
    k = F.col("doc_id") % 5
    title = F.regexp_replace("text", "[^a-zA-Z0-9 ]", "_")
    latin = F.decode(F.encode(F.lit("공고문"), "UTF-8"), "ISO-8859-1")
    end = F.when(k == 0, ".hwp").when(k == 1, "&amp;amp;.hwp").when(k == 2, "%20.hwp").when(k == 3, "·.hwp").otherwise(F.concat(latin, F.lit(".hwp")))
    return t("documents").select("doc_id", N.filename_recover(F.concat(title, end)).alias("name"))


@query("content_disposition", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ltrim({_TITLE}) || '&b.hwp' WHEN 1 THEN '가' || doc_id || '.hwp' WHEN 2 THEN {_TITLE} || ';y.pdf' WHEN 3 THEN ltrim({_TITLE}) || '.txt' END AS name FROM documents")
def content_disposition(t):
    k = F.col("doc_id") % 5
    title = F.regexp_replace("text", "[^a-zA-Z0-9 ]", "_")
    tail = (
        F.when(k == 0, F.concat(F.lit("filename="), title, F.lit("&amp;amp;b.hwp; size=10")))
        .when(k == 1, F.concat(F.lit("filename*=UTF-8''%EA%B0%80"), F.col("doc_id").cast("string"), F.lit(".hwp; filename=other")))
        .when(k == 2, F.concat(F.lit('filename="'), title, F.lit(';y.pdf"')))
        .when(k == 3, F.concat(F.lit("filename*=bad''%FF; filename="), title, F.lit(".txt")))
        .otherwise("size=10")
    )
    return t("documents").select("doc_id", N.content_disposition(F.concat(F.lit("attachment; "), tail)).alias("name"))

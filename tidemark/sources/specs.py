"""What each announcement source looks like, as data, and the column expressions that read its pages.

Names, hosts, patterns and labels are fixed values of the sites.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U


@dataclass(frozen=True)
class SourceSpec:
    """One source. fields: output name to a function of the row's html and its cells."""

    name: str
    row: str
    anchor: str  # group 1: link, 2: id, 3: title
    base: str
    hosts: tuple[str, ...]
    id_in_url: str
    body: tuple[tuple[str, ...], tuple[str, ...]]
    robots: tuple[str, ...] = ()
    fields: dict[str, object] = field(default_factory=dict)


TR = r"(?s)<tr>.*?</tr>"
FOOT = (r"<footer\b", r'<div[^>]+id="footer"')


def cells(row: Column) -> Column:
    """Texts of the row's cells: tags to spaces, cleaned."""
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda td: X.clean(F.regexp_replace(td, "<[^>]+>", " ")))


def cell(row: Column, k: int) -> Column:
    return F.coalesce(F.get(cells(row), F.lit(k)), F.lit(""))


def first_cell(row: Column, test) -> Column:
    """The first cell that passes the test; else empty."""
    return F.coalesce(F.get(F.filter(cells(row), test), F.lit(0)), F.lit(""))


def labelled(row: Column, pattern: str, only: tuple[str, ...] = ()) -> Column:
    """Group 1 of the first match, cleaned (only: see X.unescape); else empty."""
    return X.clean(F.regexp_extract(row, pattern, 1), only)


def nonempty(values: Column, glue: str) -> Column:
    return F.array_join(F.filter(values, lambda x: x != ""), glue)


def _period(of):
    """The two period fields from a function of the row."""
    return {"apply_start": lambda r: X.split_period(of(r))[0], "apply_end": lambda r: X.split_period(of(r))[1]}


def _reg_last(row: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(row, F.lit(r'<span class="bco">\s*(\d{4}-\d{2}-\d{2})\s*</span>'), F.lit(1)), F.lit(-1)), F.lit(""))


SPECS = {
    s.name: s
    for s in (
        SourceSpec(
            "bizinfo",
            TR,
            r'(?s)href\s*=\s*"([^"]*pblancId=(PBLN_\d+)[^"]*)"[^>]*>\s*(.*?)</a>',
            "https://www.bizinfo.go.kr/sii/siia/selectSIIA200Detail.do?pblancId=",
            ("=www.bizinfo.go.kr", "=bizinfo.go.kr"),
            r"pblancId=(PBLN_\d+)",
            ((r'<div[^>]+class="[^"]*view_cont[^"]*"', r'<div[^>]+id="print_area"'), (r'<div[^>]+id="footer"', r"<footer\b", r'<div[^>]+class="[^"]*footer', r'<div[^>]+class="[^"]*btn_area', r'<div[^>]+class="[^"]*paging', "목록으로|이전글|다음글")),
            ("/super", "/upload", "/html", "/images", "/agspa", "/error", "/common", "/lib", "/WEB-INF", "/download", "/direct_do"),
            {"field": lambda r: cell(r, 1), "org": lambda r: F.when(F.size(cells(r)) > 5, nonempty(F.slice(cells(r), 5, 2), " / ")).otherwise(""), "reg_date": lambda r: cell(r, 6), **_period(lambda r: cell(r, 3))},
        ),
        SourceSpec(
            "nipa",
            TR,
            r'(?s)href="(/home/2-2/(\d+))"[^>]*>(.*?)</a>',
            "https://www.nipa.kr",
            ("=www.nipa.kr", "=nipa.kr"),
            r"/home/2-2/(\d+)",
            ((r'<div[^>]+class="[^"]*tbWrap[^"]*gonggo[^"]*"', r'<div[^>]+class="[^"]*hwp_editor_board_content[^"]*"'), FOOT),
            (),
            {"field": lambda r: labelled(r, r'<span class="box[^"]*">([^<]+)</span>'), "org": lambda r: F.lit("NIPA"), "reg_date": _reg_last, **_period(lambda r: F.regexp_extract(r, r"신청기간\s*:\s*([^<]+)", 1))},
        ),
        SourceSpec(
            "kocca",
            TR,
            r'(?s)href="(/kocca/pims/view\.do\?intcNo=([^&"]+)[^"]*)"[^>]*>(.*?)</a>',
            "https://www.kocca.kr",
            ("=www.kocca.kr", "=kocca.kr"),
            r"intcNo=([A-Za-z0-9]+)",
            ((r'<div[^>]+id="contents_body"',), FOOT),
            ("/kocca/member/", "/kocca/online", "/*/FileDown.do", "/kocca/counsel/", "/cop/", "/portal/", "/kocca/searchList.do", "/kocca/*/list.do", "/kocca/bbs/list/*.do"),
            {"field": lambda r: labelled(r, r'<span class="category_color\d+">([^<]+)</span>'), "org": lambda r: F.lit("KOCCA"), "reg_date": lambda r: X.norm_date(F.regexp_extract(r, r'data-label="공고일">\s*([^<]+)', 1)), **_period(lambda r: F.regexp_extract(r, r'data-label="접수기간">\s*([^<]+)', 1))},
        ),
        SourceSpec(
            "smtech",
            TR,
            r'(?s)href="(/front/ifg/no/notice02_detail\.do[^"]*ancmId=([^&"]+)[^"]*)"[^>]*>(.*?)</a>',
            "https://www.smtech.go.kr",
            ("=www.smtech.go.kr", "=smtech.go.kr"),
            r"ancmId=([A-Za-z0-9]+)",
            ((r'<div[^>]+id="subcontent"',), FOOT),
            ("/SBA/SA/SbjtAppl_selectSbjtApplList.do", "/SBA/ETC/RechSbjtAppl_forwardRechSbjtApplList.do?RECH_ANCM_ID=S20131", "/csg/qn/qna_list.do", "/front/nmbi/", "/nmbi/"),
            {"field": lambda r: cell(r, 1), "org": lambda r: F.lit("SMTECH(중소기업기술정보진흥원)"), "reg_date": lambda r: first_cell(r, lambda t: F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}$"))), **_period(lambda r: first_cell(r, lambda t: F.contains(t, F.lit("~"))))},
        ),
    )
}
DOMAINS = {name: s.hosts for name, s in SPECS.items()}


def rows(pages: DataFrame, row: str, html: str = "html") -> DataFrame:
    """pages with row_no and row: one output row for each match of the row pattern."""
    return pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(row), F.lit(0))).alias("row_no", "row"))


def read_list(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """Announcement rows of one source's landed list pages (page_no, html); rows without the link are none."""
    found = rows(pages.select("page_no", "html"), spec.row).withColumn("id", F.regexp_extract("row", spec.anchor, 2)).where("id <> ''")
    link = U.canonical(X.unescape(F.regexp_extract("row", spec.anchor, 1)))
    title = X.clean(F.regexp_replace(F.regexp_extract("row", spec.anchor, 3), r"(?s)<!--.*?-->", "")) if spec.name == "nipa" else X.clean(F.regexp_extract("row", spec.anchor, 3))
    url = F.concat(F.lit(spec.base), F.col("id") if spec.base.endswith("=") else link)
    own = {name: f(F.col("row")) for name, f in spec.fields.items()}
    return found.select(F.lit(spec.name).alias("source"), F.col("id").alias("source_id"), title.alias("title"), *(own[c].alias(c) for c in ("field", "org", "apply_start", "apply_end", "reg_date")), url.alias("url"), "page_no", "row_no")


def _after_first(pieces: Column) -> Column:
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


LIST_HEAD, LIST_ITEM = 'id="bizPbancList"', r'<li class="notice">|<li >|<li>'


def read_main_list(pages: DataFrame, name: str = "kstartup", detail: str = "https://www.k-startup.go.kr/web/contents/bizpbanc-ongoing.do?schM=view&pbancSn=") -> DataFrame:
    """Announcement rows of the portal whose list follows a carousel: only what comes after the list's head."""
    at = F.instr("html", LIST_HEAD)
    body = F.when(at > 0, F.substring(F.col("html"), at, F.length("html")))
    items = pages.select("page_no", F.posexplode(_after_first(F.split(body, LIST_ITEM))).alias("row_no", "row")).withColumn("id", F.regexp_extract("row", r"go_view\((\d+)\)", 1)).where("id <> ''")
    one = lambda p: X.squeeze(F.regexp_extract("row", p, 1))
    spans = F.transform(F.regexp_extract_all("row", F.lit(r'<span class="list"><i[^>]*></i>([^<]+)</span>'), F.lit(1)), X.squeeze)
    nth = lambda k: X.unescape(F.coalesce(F.get("spans", F.lit(k)), F.lit("")))
    return items.withColumn("spans", spans).select(
        F.lit(name).alias("source"),
        F.col("id").alias("source_id"),
        X.unescape(one(r'<p class="tit">\s*([^<]+)')).alias("title"),
        X.unescape(one(r'<span class="flag type\d+">\s*([^<]+)</span>')).alias("category"),
        one(r'<span class="flag day">\s*([^<]+)</span>').alias("dday"),
        nth(0).alias("program"),
        nth(1).alias("org"),
        X.norm_date(X.prefix_pick(F.col("spans"), "시작일자")).alias("apply_start"),
        X.norm_date(X.prefix_pick(F.col("spans"), "마감일자")).alias("apply_end"),
        one(r'<span class="flag_agency">\s*([^<]+)</span>').alias("agency_type"),
        F.concat(F.lit(detail), F.col("id")).alias("url"),
        "page_no",
        "row_no",
    )


#: How detail pages link their attachments. pattern groups: url part, name; tail cut from names.
ATTACHMENTS = {
    "bizinfo": (r'href="((?:/cmm/fms/|/uploads/)[^"]+)"', "https://www.bizinfo.go.kr", None, None),
    "nipa": (r'(?s)href="(/comm/getFile\?[^"]+)"[^>]*>(.*?)</a>', "https://www.nipa.kr", r"(?s)\(파일크기.*$", None),
    "smtech": (r"(?s)<a[^>]*cfn_AtchFileDownload\('([0-9A-Fa-f]+)'\s*,\s*'([^']*)'[^>]*>(.*?)</a>", "https://www.smtech.go.kr", None, "/comn/AtchFileDownload.do?atchFileId="),
    "kstartup": (r'href="(/afile/fileDownload/[^"]+)"', "https://www.k-startup.go.kr", None, None),
}


def distinct_by_url(files: Column) -> Column:
    """array<struct<url, filename>> with the first of each url."""
    urls = F.transform(files, lambda f: f["url"])
    return F.filter(files, lambda f, k: F.array_position(urls, f["url"]) == k + 1)


def attachments(page: Column, source: str) -> Column:
    """Attachment links of a detail page, array<struct<url, filename>>, the first of each url."""
    pattern, base, tail, download = ATTACHMENTS[source]
    group = lambda k: F.regexp_extract_all(page, F.lit(pattern), F.lit(k))
    if source == "smtech":
        made = F.transform(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c")), lambda z: F.struct(F.concat(F.lit(base), F.coalesce(F.nullif(z["b"], F.lit("")), F.lit("/front")), F.lit(download), z["a"]).alias("url"), F.nullif(X.clean(F.regexp_replace(z["c"], "<[^>]+>", " ")), F.lit("")).alias("filename")))
    elif tail:
        made = F.transform(F.arrays_zip(group(1).alias("a"), group(2).alias("b")), lambda z: F.struct(F.concat(F.lit(base), X.unescape(z["a"])).alias("url"), F.nullif(X.clean(F.regexp_replace(F.regexp_replace(z["b"], tail, ""), "<[^>]+>", " ")), F.lit("")).alias("filename")))
    elif source == "kstartup":
        blocks = _after_first(F.split(page, '<li class="clear">'))
        one = lambda b, p: F.nullif(F.regexp_extract(b, p, 1), F.lit(""))
        made = F.filter(F.transform(blocks, lambda b: F.struct(F.concat(F.lit(base), X.unescape(one(b, pattern))).alias("url"), F.coalesce(X.unescape(one(b, r'class="file_bg"[^>]*>\s*([^<]+?)\s*</a>')), F.substring_index(one(b, pattern), "/", -1)).alias("filename"))), lambda f: f["url"].isNotNull())
    else:
        made = F.transform(group(1), lambda u: F.struct(F.concat(F.lit(base), X.unescape(u)).alias("url"), F.substring_index(F.substring_index(X.unescape(u), "/", -1), "?", 1).alias("filename")))
    return distinct_by_url(made)

"""Text, date and hash functions of announcement pages."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs between the two dates of a period.
PERIOD_SIGNS = "[~∼～]"

#: Markers of a refusal that arrives as an ordinary page, looked for in its first 4,000 characters.
BLOCK_MARKERS = (
    "captcha",
    "recaptcha",
    "verify you are human",
    "are you a robot",
    "access denied",
    "forbidden",
    "접근이 제한",
    "접근이 차단",
    "비정상적인 접근",
    "자동입력 방지",
    "로봇이 아닙",
    "일시적으로 차단",
)


#: Every HTML5 entity by name, as the standard library lists them: with a final semicolon, the older ones also without.
_NAMED = json.dumps(html.entities.html5)
_OLDER = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
UNKNOWN, LAST_CODE = "\ufffd", 0x10FFFF


def _charset(n: int) -> str:
    """What a reference to 0x80 .. 0x9F means: Windows-1252 where it has a character."""
    return bytes([n]).decode("cp1252", "ignore") or chr(n)


def _character(code: Column) -> Column:
    """The character of a code point as the HTML standard reads it."""
    spelled = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
    return (
        F.when((code == 0) | (code > LAST_CODE) | code.between(0xD800, 0xDFFF), UNKNOWN)
        .when(code.between(0x80, 0x9F), F.get(F.array(*(F.lit(_charset(n)) for n in range(0x80, 0xA0))), (code - 0x80).cast("int")))
        .when(code.between(0x01, 0x08) | code.between(0x0E, 0x1F) | (code == 0x0B) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE), "")
        .otherwise(spelled)
    )


def let(value: Column, body) -> Column:
    """body of a value that is written down, and worked out, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(number: Column) -> Column:
    """The character of a numeric reference."""
    digits = F.regexp_replace(number, "^#[xX]?0*|;$", "")
    value = F.when(F.regexp_like(number, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits)
    return let(F.when(digits == "", F.lit(0).cast("long")).when(F.length(digits) > 8, F.lit(LAST_CODE + 1).cast("long")).otherwise(value.cast("long")), _character)


def _resolved(piece: Column) -> Column:
    """The text after an ampersand with the reference that it begins with resolved."""
    number = F.regexp_extract(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    names = F.array(F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(piece, f"^(?:{_OLDER})", 0))
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    found = F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at(named, n).alias("value")))
    first = F.get(F.filter(found, lambda f: f["value"].isNotNull()), F.lit(0))
    rest = lambda name: F.substring(piece, F.length(name) + 1, F.length(piece))
    other = let(first, lambda f: F.when(f.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(f["value"], rest(f["name"]))))
    return let(number, lambda n: F.when(n != "", F.concat(_numbered(n), rest(n))).otherwise(other))


def _listed(piece: Column, only: tuple[str, ...]) -> Column:
    """The same for references of these names alone, the longest first."""
    text = F.concat(F.lit("&"), piece)
    for name in sorted(only, key=len):
        text = F.when(F.startswith(piece, F.lit(name)), F.concat(F.lit(html.entities.html5[name]), F.substring(piece, F.lit(len(name) + 1), F.length(piece)))).otherwise(text)
    return text


def unescape(c: Column, only: tuple[str, ...] = ()) -> Column:
    """Every HTML5 reference decoded once, in the JVM; text without an ampersand is left as it is. With only,
    the references of these names (as spelled after the ampersand) and no others."""

    def decoded(text: Column) -> Column:
        pieces = F.split(text, "&")
        after = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda piece: _listed(piece, only) if only else _resolved(piece))
        return F.when(F.contains(text, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(after, ""))).otherwise(text)

    return let(c, decoded)


def squeeze(c: Column) -> Column:
    """Unicode white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean(c: Column, only: tuple[str, ...] = ()) -> Column:
    return squeeze(unescape(F.coalesce(c, F.lit("")), only))


def _iso(c: Column, pattern: str, century: str) -> Column:
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.concat(F.lit(century), part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"))


LONG_DATE = r"(?U)(\d{4})[.\-/\s]+(\d{1,2})[.\-/\s]+(\d{1,2})"
SHORT_DATE = r"(?U)(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})"


def norm_date(c: Column, mode: str = "crawl") -> Column:
    """The first date in the text as YYYY-MM-DD, else the text. mode 'crawl' cleans and takes two-digit
    years too; mode 'api' takes eight digits and leaves entities alone."""
    if mode == "api":
        c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
        eight = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
        return F.when(F.regexp_like(c, F.lit(LONG_DATE)), _iso(c, LONG_DATE, "")).when(F.regexp_like(c, F.lit(r"(?U)^\d{8}$")), eight).otherwise(c)
    dated = lambda c: F.when(F.regexp_like(c, F.lit(LONG_DATE)), _iso(c, LONG_DATE, "")).when(F.regexp_like(c, F.lit(SHORT_DATE)), _iso(c, SHORT_DATE, "20")).otherwise(c)
    return let(clean(c), dated)


def split_period(c: Column) -> tuple[Column, Column]:
    """Start and end of a period; anything but two parts is all end."""
    c = F.coalesce(c, F.lit(""))
    parts = F.split(c, PERIOD_SIGNS)
    two = F.size(parts) == 2
    return F.when(two, norm_date(parts[0])).otherwise(""), F.when(two, norm_date(F.get(parts, F.lit(1)))).otherwise(norm_date(c))


def dday(deadline: Column, today: Column) -> Column:
    """D-n up to the day itself; empty when past or not a date."""
    days = F.date_diff(F.try_to_date(deadline, "yyyy-MM-dd"), today)
    return F.when(days >= 0, F.concat(F.lit("D-"), days.cast("string"))).otherwise("")


def is_open(progress: Column, end: Column, today: Column) -> Column:
    """Not marked closed, and not past its end; what can't be told stays."""
    return F.when(F.upper(F.coalesce(progress, F.lit(""))) == "N", F.lit(False)).otherwise(F.coalesce(F.try_to_date(norm_date(end, "api"), "yyyy-MM-dd") >= today, F.lit(True)))


def strip_html(c: Column, only: tuple[str, ...] = ()) -> Column:
    """Scripts and styles dropped, tags to line breaks, entities (see unescape) decoded, blank lines collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    c = unescape(F.regexp_replace(c, "<[^>]+>", "\n"), only)
    return F.regexp_replace(c, r"(?U)\n\s*\n+", "\n")


def body_slice(page: Column, starts: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """From the first start marker (in list order) that occurs, to the earliest end marker after it."""
    places = [F.regexp_instr(page, F.lit(p)) for p in starts]
    begin = F.coalesce(*(F.when(p > 0, p) for p in places), F.lit(1))
    rest = F.substring(page, begin, F.length(page))
    stops = [F.regexp_instr(rest, F.lit(p)) for p in ends]
    stop = F.least(*(F.when(p > 0, p) for p in stops)) if len(stops) > 1 else F.when(stops[0] > 0, stops[0])
    return F.when(stop.isNotNull(), F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)


def extract_body(page: Column, starts: tuple[str, ...], ends: tuple[str, ...], only: tuple[str, ...] = ()) -> Column:
    return strip_html(body_slice(page, starts, ends), only)


def coalesce_pick(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed; else empty."""
    trimmed = lambda c: F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(*(F.nullif(trimmed(c), F.lit("")) for c in columns), F.lit(""))


def prefix_pick(values: Column, label: str) -> Column:
    """The first entry that starts with the label, without it; else empty."""
    hit = F.get(F.filter(values, lambda x: F.startswith(x, F.lit(label))), F.lit(0))
    return F.coalesce(F.trim(F.replace(hit, F.lit(label), F.lit(""))), F.lit(""))


def looks_blocked(page: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(page, F.lit("")), 1, 4000))
    found = F.lit(False)
    for marker in BLOCK_MARKERS:
        found = found | F.contains(head, F.lit(marker))
    return found


def body_hash(body: Column) -> Column:
    """Version 2: of the body text alone."""
    return F.sha2(F.encode(body, "UTF-8"), 256)


def content_hash(body: Column, attachment_hashes: Column) -> Column:
    """Version 3: of the body and the sorted attachment hashes, a line each."""
    return F.sha2(F.encode(F.concat(body, F.lit("\n"), F.array_join(F.array_sort(attachment_hashes), "\n")), "UTF-8"), 256)

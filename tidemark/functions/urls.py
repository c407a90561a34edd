"""URL predicates and parts."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased host without user, port or trailing dots; null if there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.+$", "")


def host_in(h: Column, allowed: tuple[str, ...]) -> Column:
    """'=name' admits that host alone, 'name' its subdomains too."""
    found = F.lit(False)
    for name in allowed:
        own = name.removeprefix("=")
        found = found | (h == own)
        if own == name:
            found = found | F.endswith(h, F.lit("." + own))
    return F.coalesce(found, F.lit(False))


def host_allowed(url: Column, allowed: tuple[str, ...]) -> Column:
    """https only, and a host that is admitted."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lit(False)) & host_in(host(url), allowed)


def source_of_url(url: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """The first source whose host list admits the URL; null if none."""
    chain = None
    for name, allowed in domains.items():
        fits = host_allowed(url, allowed)
        chain = F.when(fits, name) if chain is None else chain.when(fits, name)
    return chain


def canonical(url: Column) -> Column:
    """Without a session id in the path."""
    return F.regexp_replace(url, ";jsessionid=[^?]*", "")


def slug(url: Column) -> Column:
    """A file name for a page: its address in word characters, and eight digits of its hash."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    return F.concat(F.substring(F.regexp_replace(rest, r"(?U)\W+", "_"), 1, 80), F.lit("_"), F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 8))


def id_of(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def robots_regex(pattern: str) -> str:
    """A robots pattern as an anchored regular expression: '*' stands for anything, a final '$' for the end."""
    end = pattern.endswith("$")
    own = pattern[:-1] if end else pattern
    return "^" + ".*".join(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", x) for x in own.split("*")) + ("$" if end else "")


def path_matches(path: Column, patterns: tuple[str, ...]) -> Column:
    """Does a path (with its query) meet any robots pattern."""
    found = F.lit(False)
    for p in patterns:
        found = found | (F.startswith(path, F.lit(p)) if "*" not in p and not p.endswith("$") else F.regexp_like(path, F.lit(robots_regex(p))))
    return found


#: A path may be percent-encoded so many times over.
DECODINGS = 5
#: The parts of any address (RFC 3986, appendix B): authority, path, query.
ADDRESS = r"(?s)^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def percent_decoded(c: Column) -> Column:
    """One round of percent-decoding; null where an escape is malformed or the bytes aren't UTF-8."""
    after = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    bad = F.contains(after, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd"))
    return F.when(F.contains(c, F.lit("%")), F.when(~bad, after)).otherwise(c)


def plain_path(c: Column) -> Column:
    """The normal form of a path with its query: no empty or '.' segments, '..' resolved, one slash ahead of an
    absolute path and none at the end."""
    path = F.substring_index(c, "?", 1)
    query = F.substring(c, F.length(path) + 1, F.length(c))
    segments = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda held, x: F.when(x.isin("", "."), held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(segments, "/"), query)


def robots_allowed(patterns: tuple[str, ...]):
    """A function of an address: is it free of the patterns. The path is decoded round by round until nothing
    changes; a pattern forbids it if it meets any round, the round with one leading slash, or its normal form. What
    can't be decoded to the end isn't allowed."""

    def allowed(url: Column) -> Column:
        own = F.translate(F.coalesce(url, F.lit("")), "\t\n\r", "")
        part = lambda k: F.regexp_extract(own, ADDRESS, k)
        target = F.concat(part(2), F.when(part(3) != "", F.concat(F.lit("?"), part(3))).otherwise(""))
        target = F.nullif(target, F.lit("\0"))  # nullable, as later rounds are
        rounds = F.aggregate(F.sequence(F.lit(1), F.lit(DECODINGS + 1)), F.array(target), lambda held, _: F.concat(held, F.array(percent_decoded(F.element_at(held, -1)))))
        settled = F.coalesce(F.get(rounds, F.lit(DECODINGS)) == F.get(rounds, F.lit(DECODINGS + 1)), F.lit(False))
        meets = lambda x: path_matches(x, patterns) | path_matches(F.regexp_replace(x, "^/+", "/"), patterns) | path_matches(plain_path(x), patterns)
        odd_host = F.contains(part(1), F.lit("[")) != F.contains(part(1), F.lit("]"))
        return url.isNotNull() & settled & ~odd_host & ~F.exists(F.array_compact(rounds), meets)

    return allowed


def redacted(c: Column, secret: str) -> Column:
    """The secret and its URL encodings replaced; escapes in either case, longest form first."""
    forms = {secret, urllib.parse.quote(secret, safe=""), urllib.parse.quote_plus(secret), urllib.parse.quote(secret, safe="%"), urllib.parse.unquote(secret)} - {""}

    def pattern(form: str) -> str:
        pieces = re.split("(%[0-9A-Fa-f]{2})", form)
        return "".join(f"(?i:{x})" if k % 2 else re.sub(r"([^A-Za-z0-9])", r"\\\1", x) for k, x in enumerate(pieces))

    return F.regexp_replace(c, "|".join(pattern(f) for f in sorted(forms, key=lambda f: (-len(f), f))), "<KEY>") if forms else c

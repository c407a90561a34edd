"""Main-text extraction with consensus host paths.

1. Each page is parsed once; its containers are scored by the prose they hold (text outside menus, notices,
   forms and the like, less link text), and the page proposes the path of its article or main element or, without
   one, of the deepest container that holds all text not set apart: tags and classes from the root down, with
   digits generalised.
2. Spark sums the proposals per host and path; each host's best path wins.
3. Each page is parsed again and the containers on its host's winning path are extracted; a page whose own
   proposal holds a block that is not among them falls back to that proposal.

The winners travel to the tasks as a broadcast while they are few (BROADCAST_HOSTS, about 100 bytes each);
beyond that, pages meet them by a join on host and a salt, so that a host with a third of all pages is dealt
to many tasks.

Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ""; repeated
rows are extracted alike; an empty table gives an empty result. Columns of the input named like a result
are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import cut, fresh

MADE = ("text", "n_chars", "path")
BROADCAST_HOSTS = 200_000
SALTS = 64
#: Containers nested deeper than this belong to the one at this depth.
DEEPEST = 200

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!?\??(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!?\??(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
CLASS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head textarea title".split())
#: Elements that hold no article text.
APART = frozenset("nav footer aside form button select menu dialog input option label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td th table tbody tr ul ol dl li blockquote figure header center details".split()) | APART
#: Words in a class, an id or a role that set an element apart from the article.
WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer footnotes form "
    "hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup privacy promo promoted "
    "promotion recommended related reply replies respond search share sharing sidebar signup site-header skip social sponsor sponsored subscribe subscription "
    "tags toolbar warning widget widgets".split()
)
#: Names of frames whose articles aren't the page's where a main heading stands outside of them.
REMARKS = frozenset("comment comments replies respond related recommended".split())
IDENTITY = re.compile(r"[a-z]+")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in CLASS.finditer(raw)} if raw else {}


def set_apart(tag: str, own: dict[str, str], in_article: bool) -> int:
    """2: not of the article by its element or by being hidden; 1: by its names, which may also describe a
    frame around the article; 0: neither."""
    if tag in APART or (tag == "header" and not in_article):
        return 2
    if tag in ("html", "body", "main"):
        return 0
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return 2
    for key in ("class", "id", "role"):
        for name in own.get(key, "").lower().split():
            if name in WORDS or not WORDS.isdisjoint(IDENTITY.findall(name)):
                return 1
    return 0


def step(tag: str, own: dict[str, str]) -> str:
    names = sorted({re.sub("[0-9]+", "N", c) for c in own.get("class", "").lower().split()})
    return ".".join([tag, *names])


class Page:
    """Blocks of one page in page order: text, link characters, and the chain of open containers."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, link characters, container
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.tag: list[str] = [""]
        self.apart: list[int] = [0]
        self.remarks: list[bool] = [False]
        self.heads: list[int] = []  # containers of main headings
        self._read(source)
        self._settle()
        self._drop_link_lists()

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("", 0)]
        count: Counter[str] = Counter()  # open elements by tag
        held: list[str] = []
        linked, in_link = 0, False

        def close() -> None:
            nonlocal linked
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text:
                    self.blocks.append((text, min(linked, len(text)), open_[-1][1]))
                held.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece and self.apart[open_[-1][1]] < 2:
                held.append(piece)
                if in_link:
                    linked += len(piece.strip())

        at, end, last_tag = 0, len(source), source.rfind(">")
        while at < end:
            m = TAG.search(source, at) if at <= last_tag or source.find("<!--", at) >= 0 else None
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag or m[0][1] in "!?":
                continue
            closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag in RAW:
                if not closing and not raw.endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|<body[\s>]", re.I).search(source, at)
                    at = end if stop is None else stop.start() if stop[0].lower().startswith("<body") else stop.end()
                close() if tag not in ("svg", "math") else None
                continue
            if tag == "a":
                in_link = not closing
            if tag in INLINE:
                continue
            close()
            if tag == "h1" and not closing:
                self.heads.append(open_[-1][1])
            if tag not in CONTAINERS or tag in VOID:
                continue
            in_link = False
            if closing:
                while count[tag]:
                    last, _ = open_.pop()
                    count[last] -= 1
                    if last == tag:
                        break
                continue
            if tag in ("li", "td", "th", "tr") and count[tag]:  # an item without an end tag ends at the next
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] == tag:
                        count.subtract(t for t, _ in open_[k:])
                        del open_[k:]
                        break
                    if open_[k][0] in ("ul", "ol", "table", "article", "main", "body") or open_[k][0] == "tr" and tag != "tr":
                        break
            if raw.endswith("/") and tag not in ("div", "li"):
                continue
            above = open_[-1][1]
            own = attributes(raw)
            apart = 2 if self.apart[above] == 2 else set_apart(tag, own, count["article"] + count["main"] > 0)
            count[tag] += 1
            if len(open_) > DEEPEST and apart in (0, self.apart[above]):
                open_.append((tag, above))
                continue
            self.parent.append(above)
            self.path.append(f"{self.path[above]}>{step(tag, own)}" if self.path[above] else step(tag, own))
            self.tag.append(tag)
            self.apart.append(apart)
            self.remarks.append(apart == 1 and not REMARKS.isdisjoint(f"{own.get('class', '')} {own.get('id', '')}".lower().split()))
            open_.append((tag, len(self.tag) - 1))
        close()

    def _settle(self) -> None:
        """Names set a container apart, unless it frames the main element, a main heading or, if no other is left,
        the article (not one among remarks on what a main heading heads). Blocks of what stays apart go."""

        def below(lifted: set[int]) -> list[bool]:
            out = [False] * len(self.tag)
            for k in range(1, len(self.tag)):
                out[k] = out[self.parent[k]] or (self.apart[k] > 0 and k not in lifted)
            return out

        lifted: set[int] = set()
        if 1 in self.apart:
            core = [*self.heads, *(k for k, tag in enumerate(self.tag) if tag == "main")]
            lifted = {a for k in core for a in self.chain(k) if self.apart[a] == 1}
            gone = below(lifted)
            if not any(tag in ("article", "main") and not out for tag, out in zip(self.tag, gone)):
                headed = any(not gone[k] for k in self.heads)
                frames = [self.chain(k) for k, tag in enumerate(self.tag) if tag == "article" and not self.apart[k]]
                lifted |= {a for chain in frames if not (headed and any(self.remarks[a] and a not in lifted for a in chain)) for a in chain if self.apart[a] == 1}
        gone = below(lifted)
        self.blocks = [b for b in self.blocks if not gone[b[2]]]
        self.heads = [k for k in self.heads if not gone[k]]

    def _drop_link_lists(self) -> None:
        """Lists that are nearly all links are menus, whatever their names."""
        chars, links, n = [0] * len(self.tag), [0] * len(self.tag), [0] * len(self.tag)
        for text, linked, at in self.blocks:
            while at > 0:
                chars[at] += len(text)
                links[at] += linked
                n[at] += linked > 0
                at = self.parent[at]
        menu = [tag in ("ul", "ol", "dl", "table", "div", "section") and n[k] >= 3 and links[k] > 0.8 * chars[k] for k, tag in enumerate(self.tag)]
        if any(menu):
            self.blocks = [b for b in self.blocks if not any(menu[k] for k in self.chain(b[2]))]

    def chain(self, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(at)
            at = self.parent[at]
        return out

    def masses(self) -> list[int]:
        """Prose below each container; at 0 that of the page."""
        mass = [0] * len(self.tag)
        for text, linked, at in self.blocks:
            prose = max(0, len(text) - 2 * linked)
            mass[0] += prose
            while at > 0:
                mass[at] += prose
                at = self.parent[at]
        return mass

    def frame(self) -> int:
        """The deepest container that holds every main heading and every block that isn't a link alone."""
        common: list[int] | None = None
        for k in {*self.heads, *(at for text, linked, at in self.blocks if linked < len(text))}:
            down = self.chain(k)[::-1]
            common = down if common is None else [a for a, b in zip(common, down) if a == b]
        return common[-1] if common else 0

    def proposal(self) -> tuple[str, float]:
        """Path of the best container, and its share of the page's prose."""
        mass = self.masses()
        if not mass[0]:
            return "", 0.0
        best = [k for k, tag in enumerate(self.tag) if tag in ("article", "main") and mass[k] >= 0.5 * mass[0]]
        at = max(best, key=lambda k: (self.tag[k] == "article", mass[k], -k)) if best else self.frame()
        return self.path[at], mass[at] / mass[0]

    def below(self, path: str) -> list[int]:
        """The blocks below the containers on the path."""
        return [n for n, b in enumerate(self.blocks) if path == "" or any(self.path[k] == path for k in self.chain(b[2]))]

    def extract(self, path: str | None) -> tuple[str, str]:
        """Text below the containers on the path and the path used: the page's own if the given one leaves
        out a block that the own one holds."""
        own = self.proposal()[0]
        got = self.below(own)
        if path and path != own:
            found = self.below(path)
            if set(got) <= set(found):
                own, got = path, found
        return "\n".join(self.blocks[n][0] for n in got), own


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def proposals(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, path and share: what each page proposes; summed per batch already, as hosts repeat."""

    def run(batches):
        for batch in cut(batches, "html"):
            votes: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source:
                    path, share = Page(source).proposal()
                    if path:
                        votes[host, path] = votes.get((host, path), 0.0) + share
            yield pa.RecordBatch.from_pydict({"host": [h for h, _ in votes], "path": [p for _, p in votes], "votes": list(votes.values())}, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.float64())]))

    return pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, votes double")


def winners(votes: DataFrame) -> DataFrame:
    """The path with most votes of each host; of equals the first by name."""
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The rows of pages with text, n_chars and path (the container path that was extracted)."""
    spark = pages.sparkSession
    pages = fresh(pages, *MADE)
    best = winners(proposals(pages, url, html)).persist()
    few = best.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    out = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("path", T.StringType())])
    names = pages.columns
    keyed = pages.withColumn("__host", host_of(F.col(url)))
    if few:
        known = spark.sparkContext.broadcast({r["host"]: r["path"] for r in best.toLocalIterator()})
    else:
        salted = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"host": "__host", "path": "__path"})
        keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(html), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left").select(*names, "__host", "__path")
    best.unpersist() if few else None

    def run(batches):
        paths = known.value if few else {}
        for batch in cut(batches, html):
            at = {n: k for k, n in enumerate(batch.schema.names)}
            given = [paths.get(h) for h in batch.column(at["__host"]).to_pylist()] if few else batch.column(at["__path"]).to_pylist()
            got = [Page(s).extract(p) if s else ("", None) for s, p in zip(batch.column(at[html]).to_pylist(), given)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], names=out.names)

    return keyed.mapInArrow(run, out)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")



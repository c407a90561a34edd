"""URL filtering by stated rules and by mined association rules.

Stated rules come first: the longest one that fits a URL's host (or a parent domain) and path decides.
URLs that none fits are judged by rules mined by FP-growth: the tokens of labelled URLs, and their label, are
the transactions; rules that conclude "bad" are kept from a number of bad URLs and a confidence on, and dropped
where a rule with fewer tokens is at least as confident. A URL is blocked if it holds all tokens of a kept
rule. Matching goes through an inverted index from a rule's rarest token to the rule.

A URL has a token for every label of its host, every folder and every name in its query, so its subsets aren't
bounded; rules have LONGEST tokens at most, which Spark's FPGrowth can't be told. mine() therefore grows the
patterns itself: each token's conditional pattern base (equal prefixes summed, with all and bad URLs counted
side by side) is one group of a shuffle and is grown up to that length. Only rules that no shorter one
covers reach the driver.

Defined results: a null url, or one without "://", has an empty host and path and is judged by the
method (it has no tokens, so it is allowed); without labels nothing is mined and everything unmatched is
allowed; rows are judged one by one, so repeated rows and other columns don't matter; an empty table gives
an empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fresh, staged

#: A rule holds in so many bad URLs at least, whatever the size of the table, in this share of the labelled URLs
#: with its tokens, and has so many tokens at most.
MIN_COUNT, MIN_CONFIDENCE, LONGEST = 5, 0.6, 4
MADE = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict) of the contract.
STATED = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    found, said = None, None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    return (found, said) if found is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, ending and site of the host, each of its other labels and their words between
    hyphens, each folder of the path (digits as N), the name's extension, each name in the query, and the fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    others = F.slice(labels, F.lit(1), F.size(labels) - 1)
    words = F.flatten(F.transform(F.filter(others, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    folders = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "N"))
    names = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    kinds = {
        "scheme": F.array(F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)),
        "ending": F.array(F.element_at(labels, -1)),
        "site": F.array(F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))),
        "label": others,
        "word": words,
        "folder": folders,
        "extension": F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
        "query": names,
        "fragment": F.array(F.when(F.contains(url, F.lit("#")), "yes")),
    }
    kind = lambda k, v: F.transform(F.filter(v, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit(f"{k}="), x))
    return F.array_distinct(F.concat(*(kind(k, v) for k, v in kinds.items())))


def patterns(baskets: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """own (sorted tokens), n and bad (how many URLs, and bad ones, hold them all) of each set of up to
    `longest` tokens that min_count bad URLs hold, from rows of items, n and bad; by FP-growth."""
    singles = baskets.select(F.explode("items").alias("token"), "bad").groupBy("token").agg(F.sum("bad").alias("bad")).where(F.col("bad") >= min_count)
    names = [r["token"] for r in sorted(singles.toLocalIterator(), key=lambda r: (-r["bad"], r["token"]))]
    known = baskets.sparkSession.sparkContext.broadcast({token: k for k, token in enumerate(names)})

    def bases(batches):
        for batch in batches:
            held: dict[tuple[int, tuple[int, ...]], list[int]] = defaultdict(lambda: [0, 0])
            for items, n, bad in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ranks = tuple(sorted(known.value[t] for t in items if t in known.value))
                for k, rank in enumerate(ranks):
                    sums = held[rank, ranks[:k]]
                    sums[0] += n
                    sums[1] += bad
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.list_(pa.int32())), *(pa.array([v[x] for v in held.values()], pa.int64()) for x in (0, 1))], names=["token", "prefix", "n", "bad"]
            )

    def grow(table: pa.Table) -> pa.Table:
        found: list[tuple[tuple[int, ...], int, int]] = []
        todo = [((table.column("token")[0].as_py(),), list(zip((tuple(x) for x in table.column("prefix").to_pylist()), table.column("n").to_pylist(), table.column("bad").to_pylist())))]
        while todo:
            own, rows = todo.pop()
            found.append((own, sum(r[1] for r in rows), sum(r[2] for r in rows)))
            if len(own) == longest:
                continue
            count: Counter[int] = Counter()
            for prefix, _, bad in rows:
                if bad:
                    for t in prefix:
                        count[t] += bad
            for token in (t for t, bad in count.items() if bad >= min_count):
                base: dict[tuple[int, ...], list[int]] = defaultdict(lambda: [0, 0])
                for prefix, n, bad in rows:
                    if token in prefix:
                        sums = base[prefix[: prefix.index(token)]]
                        sums[0] += n
                        sums[1] += bad
                todo.append(((*own, token), [(p, *v) for p, v in base.items()]))
        ranked = list(known.value)
        return pa.table({"own": pa.array([sorted(ranked[t] for t in own) for own, _, _ in found], pa.list_(pa.string())), "n": pa.array([n for _, n, _ in found], pa.int64()), "bad": pa.array([b for _, _, b in found], pa.int64())})

    summed = baskets.select("items", "n", "bad").mapInArrow(bases, "token int, prefix array<int>, n long, bad long").groupBy("token", "prefix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return summed.groupBy("token").applyInArrow(grow, "own array<string>, n long, bad long")


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, longest: int = LONGEST) -> list[tuple[frozenset, float]]:
    """Pruned (tokens, confidence) of the rules that conclude "bad", from rows of url and a boolean label."""
    items = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(tokens(F.col(url)).alias("items"), F.col(bad).cast("long").alias("bad")).where(F.size("items") > 0)
    baskets = staged(items.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "baskets")
    made = patterns(baskets, min_count, longest).select("own", (F.col("bad") / F.col("n")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    rules = staged(made, "rules")
    # a rule goes if leaving out tokens gives one that is at least as confident
    part = lambda at: F.filter("own", lambda x, k: k.isin(at))
    parts = F.array(*(part([k for k in range(longest) if m >> k & 1]) for m in range(1, 2**longest - 1)))
    less = rules.select("own", "confidence", F.explode(F.array_distinct(parts)).alias("part")).where((F.size("part") > 0) & (F.size("part") < F.size("own")))
    covered = less.join(rules.select(F.col("own").alias("part"), F.col("confidence").alias("other")), "part").where(F.col("other") >= F.col("confidence")).select("own").distinct()
    kept = rules.join(covered, "own", "left_anti")
    return sorted(((frozenset(r["own"]), r["confidence"]) for r in kept.toLocalIterator()), key=lambda r: (len(r[0]), sorted(r[0])))


def index_of(rules: list[tuple[frozenset, float]]) -> dict[str, list[frozenset]]:
    """Inverted index: each rule under that of its tokens which the fewest rules hold."""
    held: dict[str, int] = {}
    for own, _ in rules:
        for token in own:
            held[token] = held.get(token, 0) + 1
    index: dict[str, list[frozenset]] = {}
    for own, _ in rules:
        index.setdefault(min(own, key=lambda t: (held[t], t)), []).append(own)
    return index


def filter_urls(pages: DataFrame, rules: list[tuple[frozenset, float]], url: str = "url", stated=STATED) -> DataFrame:
    """The rows of pages with host, path, rule (the stated rule that decided) and verdict (allow or block)."""
    pages = fresh(pages, *MADE)
    index = index_of(rules)

    @F.pandas_udf("boolean")
    def matches(column: pd.Series) -> pd.Series:
        def one(own) -> bool:
            held = set(own)
            return any(rule <= held for token in own for rule in index.get(token, ()))

        return pd.Series([one(own) for own in column], dtype=bool)

    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, said = stated_rule(F.col("host"), F.col("path"), stated)
    own = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": said})
    mined = F.when(matches(F.coalesce(tokens(F.col(url)), F.array().cast("array<string>"))), "block").otherwise("allow")
    return own.withColumn("verdict", F.coalesce(F.col("verdict"), mined))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels carry over to a page by the document number in its path; bad: of low quality, or toxic."""
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^0-9/]*/*$", 1), F.lit("9" * 18)).cast("long")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "bad")


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return filter_urls(pages.select("page_id", "url"), mine(labelled_pages(pages, labels))).select("page_id", "host", "path", "rule", "verdict")


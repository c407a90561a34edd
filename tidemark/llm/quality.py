"""Quality rules as a short-circuit cascade: Spark expressions only.

A rule is a boolean expression over metrics that is true where a text is to be rejected. The cascade estimates on
a bounded sample each rule's selectivity (the share of rows it rejects) and its cost (the work of the metrics it
reads: counted characters and words of the sample, at the weights of WORK), and orders rules by rejections per
cost. A CASE chain then evaluates them in that order and stops at the first that rejects; metrics are expressions
inside the chain, so those of later rules aren't computed for rejected texts. The order decides the work, never the
verdict, and is the same in every run over the same table.

Metrics: words are runs of anything but ASCII white space. n_repeat_words counts the words that lie in a
five-word window found twice or more in the text. Windows are compared by 64-bit hashes within one text. A
window found c times costs c - 1 distinct hashes, so a text with n windows and d distinct hashes has at most
10 * (n - d) such words: the rule sorts only the hashes of texts that this bound lets fail.

measured() computes every metric of every row, which a report of them needs; judged() can take them from there.

Defined results: a null text has no words and is rejected (too few words); a very long text costs one array of its
words and one of its window hashes; rows are judged one by one, so ties, repeated rows and other columns don't
matter; an empty table gives an empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fresh

WINDOW = 5
SAMPLE_ROWS = 2000
SPACE, WORDY, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Work of a metric for each character and for each word of a text, in about equal units. Splitting into words is
#: shared by all rules and counts for none.
WORK = {"n_words": (0, 0), "word_chars": (0.2, 1), "n_symbols": (1, 0), "n_shouts": (1, 0), "n_lines": (0.5, 0), "n_dup_lines": (2, 0), "n_repeat_words": (0, 40)}


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORDY)))


def window_hashes(own: Column) -> Column:
    """A hash of each five-word window of an array of words."""
    starts = F.slice(own, F.lit(1), F.greatest(F.size(own) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(own, i + k) for k in range(1, WINDOW))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sorted_pairs(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_starts(pairs: Column) -> Column:
    """Where windows start that occur twice or more, from sorted pairs of hash and place."""
    near = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda p, k: near(p, k - 1) | near(p, k + 1)), lambda p: p["i"]))


def covered(starts: Column) -> Column:
    """How many words windows from these starts cover."""
    own = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)


def repeat_words(own: Column, more_than: Column) -> Column:
    """n_repeat_words, or 0 where it is known to be no more than more_than."""
    exact = lambda h: let(sorted_pairs(h), lambda p: let(repeated_starts(p), covered))
    return let(window_hashes(own), lambda h: F.when(2 * WINDOW * (F.size(h) - F.size(F.array_distinct(h))) > more_than, exact(h)).otherwise(F.lit(0).cast("long")))


def lazy(text: Column, own: Column) -> dict[str, Column]:
    """Every metric as an expression of the text and the array of its words."""
    n = F.size(own)
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(own, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
        "n_dup_lines": let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(own, n * (REPEATED / 100.0)),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with the metrics of MADE."""
    docs = fresh(docs, *MADE)
    value = F.coalesce(F.col(text), F.lit(""))
    own = docs.withColumns({"__words": words(value), "__lines": lines_of(value)}).withColumn("__hashes", window_hashes(F.col("__words")))
    own = own.withColumn("__pairs", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), sorted_pairs(F.col("__hashes"))))
    own = own.withColumn("__starts", repeated_starts(F.col("__pairs")))
    cheap = lazy(value, F.col("__words"))
    made = {
        **{name: cheap[name] for name in ("n_words", "word_chars", "n_symbols")},
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered(F.col("__starts")), F.lit(0).cast("long")),
    }
    return own.select(*docs.columns, *once(**made))


def once(**columns: Column) -> tuple[Column]:
    """Columns from a generator of one row: filters on them stay above it, else they would be computed anew
    inside the filters."""
    return (F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))),)


#: Texts with fewer words, or a greater percentage of words in repeated windows, fail the base.
FEWEST, REPEATED = 10, 20


def base_failed(n_words: Column | None = None, n_repeat_words: Column | None = None) -> Column:
    n = F.col("n_words") if n_words is None else n_words
    again = F.col("n_repeat_words") if n_repeat_words is None else n_repeat_words
    return (n < FEWEST) | (F.lit(100) * again > F.lit(REPEATED) * n)


#: The default rules: the metrics that each reads, and when it rejects.
RULES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "few_words": (("n_words",), lambda n: n < FEWEST),
    "repeated_windows": (("n_words", "n_repeat_words"), lambda n, again: F.lit(100) * again > F.lit(REPEATED) * n),
    "word_length": (("n_words", "word_chars"), lambda n, chars: (chars < 2 * n) | (chars > 15 * F.greatest(n, F.lit(1)))),
    "symbols": (("n_words", "n_symbols"), lambda n, symbols: 10 * symbols > 2 * F.greatest(n, F.lit(1))),
    "shouting": (("n_words", "n_shouts"), lambda n, shouts: 2 * shouts > F.greatest(n, F.lit(1))),
    "repeated_lines": (("n_dup_lines", "n_lines"), lambda again, lines: 2 * again > lines),
}


def bound(rules: dict, metrics: dict[str, Column]) -> dict[str, Column]:
    """Rules as expressions over these metrics."""
    return {name: rule(*(metrics[m] for m in reads)) for name, (reads, rule) in rules.items()}


def with_words(docs: DataFrame, text: str) -> tuple[DataFrame, Column, Column]:
    """docs with the words of each text, split once; the text and its words as columns."""
    return docs.select(*docs.columns, *once(__words=words(F.coalesce(F.col(text), F.lit(""))))), F.coalesce(F.col(text), F.lit("")), F.col("__words")


def ordered(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[tuple[str, float, float]]:
    """(name, rejected share, cost) of each rule, in order of rejections per cost, from a sample of about
    sample_rows rows over the whole table, read once. The sample decides the order of rules only."""
    rows = docs.count()
    own, value, split = with_words(docs.sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=5), text)
    rejects = bound(rules, lazy(value, split))
    row = own.agg(F.count(F.lit(1)), F.sum(F.length(value)), F.sum(F.size(split)), *(F.count_if(r) for r in rejects.values())).first()
    n, chars, n_words = (x or 0 for x in row[:3])
    found = []
    for (name, (reads, _)), rejected in zip(rules.items(), row[3:]):
        cost = sum(WORK.get(m, (1, 1))[0] * chars + WORK.get(m, (1, 1))[1] * n_words for m in reads)
        found.append((name, (rejected or 0) / max(n, 1), 1.0 + cost / max(n, 1)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def verdict(order: list[str], rejects: dict[str, Column]) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does."""
    chain = None
    for name in order:
        chain = F.when(rejects[name], name) if chain is None else chain.when(rejects[name], name)
    return chain if chain is not None else F.lit(None).cast("string")


def judged(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text", metrics: bool = False) -> DataFrame:
    """The rows of docs with rejected_by (null: kept) and, if asked for, the metrics of MADE, which then serve
    the rules that read them."""
    docs = fresh(docs, "rejected_by")
    order = [name for name, _, _ in ordered(docs, rules, sample_rows, text)]
    own, value, split = with_words(docs, text) if not metrics else (measured(docs, text), F.coalesce(F.col(text), F.lit("")), F.lit(None).cast("array<string>"))
    known = {name: F.col(name) for name in MADE} if metrics else {}
    return own.select(*(c for c in own.columns if c != "__words"), *once(rejected_by=verdict(order, bound(rules, lazy(value, split) | known))))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    made = judged(docs.select("doc_id", "text"), metrics=True)
    return made.select("doc_id", *MADE, base_failed().alias("base_failed"), (~base_failed() & F.col("rejected_by").isNull()).alias("kept"))

"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is eight
consecutive words of an item, or the whole of a shorter one. Each text is scanned once in its normalised
form (words between single spaces), so all windows of all items are met in one pass; hits are mapped back
to offsets in the original text.

The benchmark is streamed to the driver and cut into blocks of at most BLOCK_BYTES of distinct windows, which
bounds an automaton's nodes (about 45 bytes of memory for each byte: under 200 MB). A block travels as a
broadcast of that bound and becomes one automaton, built once in each Python worker. A benchmark of one block, the
usual case, costs one scan and no shuffle; a larger one is scanned block by block, with a written table between
blocks.

Defined results: null texts have no words and no hits; items without words match nothing; windows of items with
a null id mark words but name no item; rows that repeat an item_id are one item; a very long text is one batch
and costs a few times its size; an empty benchmark leaves every text clean; an empty
table gives an empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import cut, fresh, staged

SIZE = 8
BLOCK_BYTES = 4 << 20
MADE = ("n_words", "n_hit", "items", "spans")
#: Bytes that are part of no word become spaces; A-Z become a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def normalised(text: bytes) -> bytes:
    """The words, each between single spaces; one space for no words."""
    return b" " + b" ".join([*text.translate(FOLD).split(), b""])


def item_windows(text: str, size: int) -> list[bytes]:
    words = normalised(text.encode("utf-8", "surrogatepass")).split()
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))] if words else []


def blocks_of(benchmark: DataFrame, item: str, text: str, size: int, block_bytes: int):
    """Blocks of windows: lists of (window, item numbers), and the names of the items in order of number."""
    names: dict[str, int] = {}
    block: dict[bytes, set[int]] = {}
    held = 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        k = None if row.i is None else names.setdefault(row.i, len(names))
        for window in item_windows(row.t, size):
            if window not in block:
                held += len(window)
            own = block.setdefault(window, set())
            if k is not None:
                own.add(k)
        if held >= block_bytes:
            yield block, names
            block, held = {}, 0
    if block:
        yield block, names


_built: dict[str, object] = {}


def automaton_of(patterns):
    """The automaton of a broadcast block; a worker keeps the last one it built for its next tasks."""
    if patterns.id not in _built:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern, what in patterns.block.value:
            automaton.add_word(pattern, what)
        automaton.make_automaton()
        _built.clear()
        _built[patterns.id] = automaton
    return _built[patterns.id]


class Patterns:
    """A block of windows as a broadcast, and a name that is its own."""

    def __init__(self, spark, block):
        self.id = uuid.uuid4().hex
        self.block = spark.sparkContext.broadcast([(w.decode("latin-1"), (w.count(b" ") - 1, sorted(k))) for w, k in block.items()])


def _scan(patterns: Patterns, names):
    """A mapInArrow function that adds one block's hits to item numbers and word marks so far."""
    ids = list(names)

    def scan(batches, text, before):
        automaton = automaton_of(patterns)
        for batch in cut(batches, text):
            at = batch.schema.get_field_index(text)
            old_items, old_spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("items", "spans")) if before else (None, None)
            n_words, n_hit, items, spans = [], [], [], []
            for row, value in enumerate(batch.column(at)):
                raw = (value.as_buffer() or b"") if value.is_valid else b""
                raw = bytes(raw)
                clean = normalised(raw)
                got, marks = set(), []
                for end, (n, which) in automaton.iter(clean.decode("latin-1")):
                    marks.append((end, n))
                    got.update(which)
                count = clean.count(b" ") - 1
                n_words.append(count)
                found = {ids[k] for k in got} | set(old_items[row] if before else ())
                items.append(sorted(found))
                if not marks and not (before and old_spans[row]):
                    n_hit.append(0)
                    spans.append([])
                    continue
                hit = np.zeros(count + 1, np.int64)
                if marks:
                    gaps = np.flatnonzero(np.frombuffer(clean, np.uint8) == 0x20)
                    ends = np.searchsorted(gaps, np.array([m[0] for m in marks]))
                    np.add.at(hit, ends - np.array([m[1] for m in marks]), 1)
                    np.add.at(hit, ends, -1)
                hit = np.cumsum(hit)[:-1] > 0
                begins, stops = original_words(raw)
                if before:
                    for s in old_spans[row]:
                        hit |= (begins >= s["begin"]) & (stops <= s["end"])
                n_hit.append(int(hit.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                spans.append([{"begin": int(begins[x]), "end": int(stops[y - 1])} for x, y in zip(edge[0::2], edge[1::2])])
            new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(_SPAN))}
            names_ = [c for c in batch.schema.names if c not in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names_), *new.values()], names=[*names_, *new])

    return scan


def original_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the original text begin and end, in code points."""
    space = np.frombuffer(raw.translate(FOLD), np.uint8) == 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return point[edge[0::2]], point[edge[1::2]]


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs with n_words, n_hit (words inside a window), items (ids of the items whose windows
    occur, sorted as strings) and spans (hit runs as code point offsets of the original text)."""
    docs = fresh(docs, *MADE)
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])
    before = False
    for block, names in blocks_of(benchmark, item, item_text, size, block_bytes):
        scan = _scan(Patterns(docs.sparkSession, block), names)
        if before:
            docs = staged(docs, "decontamination")
        docs = docs.mapInArrow(lambda batches, scan=scan, before=before: scan(batches, text, before), out)
        before = True
    if not before:
        docs = docs.mapInArrow(lambda batches: _clean(batches, text), out)
    return docs


def _clean(batches, text):
    for batch in cut(batches, text):
        n = [normalised(bytes(v.as_buffer() or b"") if v.is_valid else b"").count(b" ") - 1 for v in batch.column(batch.schema.get_field_index(text))]
        empty = [[]] * len(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64()), pa.array(empty, pa.list_(pa.string())), pa.array(empty, pa.list_(_SPAN))], names=[*batch.schema.names, "n_words", "n_hit", "items", "spans"])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of find_items."""
    found = find_items(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))

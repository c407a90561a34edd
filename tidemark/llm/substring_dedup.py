"""Substring dedup over word windows, with a count-min prefilter.

A window is `size` consecutive words of one text. A word is removed if a window that covers it also starts
in a row with a smaller id; windows are judged on the input. Steps:

1. Rows are dealt to buckets by a hash of id and text. Each bucket sketches its windows; the merged sketch, which
   is as large as the table needs and stays with the reducers (see sketch.py), overestimates how often a window
   occurs and tells each bucket which of its windows may occur elsewhere.
2. A bucket sends each window that it knows or the sketch takes for repeated once, with the smallest id it has
   for it, packed by hash range.
3. One reducer a hash range groups the windows exactly (96 bits) and answers each with one bit: does a
   smaller id exist in another bucket?
4. Each bucket, met with its answers, marks words and builds what is kept.

Nothing is keyed by a window alone, so a passage that a third of all rows share costs one entry a bucket.

Defined results: a null or empty text has no words and keeps an empty text; a text shorter than a window
loses nothing; a null id counts as larger than every id; rows with one id never remove each other's words;
a very long text is one piece of its bucket and costs about 60 bytes of memory a byte; an empty table gives an
empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import sketch
from .staging import cut, fresh, text_bytes

SIZE = 13
MADE = ("n_words", "n_removed", "kept_text", "removed", "cut_text")
LAST = np.iinfo(np.int64).max
#: Bytes a word and its space are expected to take: one window begins at each word.
WORD_BYTES = 5
_PACKET = pa.schema([("shard", pa.int32()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("who", pa.binary()), ("ids", pa.binary())])
EXACT = 1


def windows(texts, size: int):
    """The laid-out bytes with words, and for each window its first word, two hashes and the row."""
    data, at = K.lay_out(texts)
    starts, ends, first = K.words_of(data, at)
    h = K.word_hashes(data, starts, ends)
    begin = K.window_starts(first, size)
    begin = begin[begin <= len(h) - size]
    a, b = (K.window_hashes(h, size, base)[begin] if len(begin) else np.zeros(0, K.U64) for base in (K.BASE_A, K.BASE_B))
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))[begin] if len(begin) else np.zeros(0, np.int64)
    return (data, at, starts, ends, first), begin, a, b, row


def own_ids(batch: pa.RecordBatch, id_column: str) -> np.ndarray:
    return batch.column(id_column).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def pieces(table: pa.Table, text: str):
    """Record batches of bounded text, in the table's order."""
    yield from cut(table.to_batches(), text)


class Bucket:
    """The windows of a bucket: for each piece of its texts where words and windows begin, and for all windows
    two hashes and the row's id."""

    def __init__(self, table: pa.Table, id_column: str, text: str, size: int):
        self.pieces = []
        a, b, ids = [np.zeros(0, K.U64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for piece in pieces(table, text):
            words, begin, wa, wb, row = windows(piece.column(piece.schema.get_field_index(text)), size)
            self.pieces.append((piece, words, begin))
            a.append(wa)
            b.append((wb >> K.U64(32)).astype(np.uint32))
            ids.append(own_ids(piece, id_column)[row])
        self.a, self.b, self.ids = np.concatenate(a), np.concatenate(b), np.concatenate(ids)

    def keep_repeated(self, answers: pa.Table, grid: sketch.Grid) -> np.ndarray:
        """Leaves only the windows that may occur twice; which those are."""
        keys, place, here = sketch.distinct(self.a)
        keep = (here | sketch.bits_told(answers, sketch.SKETCH, keys, grid))[place] if len(keys) else np.zeros(0, bool)
        self.a, self.b, self.ids = self.a[keep], self.b[keep], self.ids[keep]
        return keep


def distinct(a, b, ids):
    """Distinct windows in hash order, the smallest id of each, and for each occurrence its place there."""
    order = np.lexsort((ids, b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return sa[new], sb[new], ids[order][new], place


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, spans: bool = True, layout: bool = False) -> DataFrame:
    """The rows of docs with n_words, n_removed, kept_text (kept words joined by one space) and, if asked
    for, removed: runs of removed words as structs of first word and end; and cut_text: the text as it is, without
    the removed words and the white space that follows them."""
    docs = fresh(docs, *MADE)
    grid = sketch.grid(docs.sparkSession, text_bytes(docs, text), WORD_BYTES)
    dealt = sketch.dealt(docs, id_column, text, grid, 2 * size - 1)

    def send_keys(table: pa.Table) -> pa.Table:
        return sketch.packets(table.column("__bucket")[0].as_py(), np.unique(Bucket(table, id_column, text, size).a), grid)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PACKET.empty_table()
        own = Bucket(table, id_column, text, size)
        own.keep_repeated(answers, grid)
        a, b, who, _ = distinct(own.a, own.b, own.ids)
        names, begin = np.unique(grid.shard_of(a), return_index=True)
        rows = {f.name: [] for f in _PACKET}
        for k, lo, hi in zip(names.tolist(), begin, [*begin[1:], len(a)]):
            ids, at = np.unique(who[lo:hi], return_inverse=True)
            for name, value in zip(rows, (k, table.column("__bucket")[0].as_py(), a[lo:hi].tobytes(), b[lo:hi].tobytes(), at.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes(), ids.tobytes())):
                rows[name].append(value)
        return pa.Table.from_pydict(rows, schema=_PACKET)

    def answer(table: pa.Table) -> pa.Table:
        a = [np.frombuffer(x.as_buffer(), K.U64) for x in table.column("a")]
        b = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("b")]
        who = [np.frombuffer(i.as_buffer(), np.int64)[np.frombuffer(w.as_buffer(), np.uint16 if len(i.as_buffer()) <= 8 << 16 else np.uint32)] for w, i in zip(table.column("who"), table.column("ids"))]
        ids = np.concatenate(who)
        _, _, least, place = distinct(np.concatenate(a), np.concatenate(b), ids)
        smaller = least[place] < ids
        at = np.cumsum([0, *map(len, a)])
        told = [np.packbits(smaller[lo:hi]).tobytes() for lo, hi in zip(at[:-1], at[1:])]
        return pa.Table.from_pydict({"bucket": table.column("bucket"), "kind": np.full(len(told), EXACT, np.int32), "shard": table.column("shard"), "told": told}, schema=sketch.ANSWER)

    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    if spans:
        out = out.add("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))
    if layout:
        out = out.add("cut_text", T.StringType())
    kept_columns = docs.columns

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Bucket(table, id_column, text, size)
        keep = own.keep_repeated(answers, grid)
        firsts, _, least, place = distinct(own.a, own.b, own.ids)
        gone = np.zeros(len(keep), bool)
        if len(firsts):
            gone[keep] = sketch.bits_told(answers, EXACT, firsts, grid)[place] | (least[place] < own.ids)
        done, made = 0, []
        for piece, (data, at, starts, ends, first), begin in own.pieces:
            hit = K.covered(begin[gone[done : done + len(begin)]], size, len(starts))
            done += len(begin)
            made.append(_kept(piece.select(kept_columns), data, starts, ends, first, hit, spans, at if layout else None))
        return pa.Table.from_batches(made)

    sent = dealt.groupBy("__bucket").applyInArrow(send_keys, sketch.PACKET_DDL)
    maybe = sketch.by_shard(sent, grid).applyInArrow(sketch.merger(grid), sketch.ANSWER_DDL).repartition(grid.buckets, "bucket")
    packets = dealt.groupBy("__bucket").cogroup(maybe.groupBy("bucket")).applyInArrow(send, "shard int, bucket long, a binary, b binary, who binary, ids binary")
    exact = sketch.by_shard(packets, grid).applyInArrow(answer, sketch.ANSWER_DDL)
    return dealt.groupBy("__bucket").cogroup(maybe.unionByName(exact).groupBy("bucket")).applyInArrow(judge, out)


def _cut(data, at, starts, first, hit):
    """The texts without the words that are hit, each up to the next word or the end of its text."""
    stop = np.append(starts[1:], at[-1])
    last = first[1:] - 1
    own = first[1:] > first[:-1]
    stop[last[own]] = at[1:][own] - 1
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, starts[hit], 1)
    np.add.at(step, stop[hit], -1)
    keep = np.cumsum(step[:-1]) == 0
    keep[at[1:] - 1] = False
    keep[at[-1] :] = False
    size = np.concatenate([[0], np.cumsum(keep)])[at].tolist()
    out = data[keep].tobytes()
    return pa.array([out[lo:hi] for lo, hi in zip(size[:-1], size[1:])], pa.binary()).cast(pa.string())


def _kept(batch, data, starts, ends, first, hit, spans, at=None):
    whole = None if at is None else _cut(data, at, starts, first, hit)
    keep = ~hit
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[keep]] += 1
    np.add.at(step, ends[keep] + 1, -1)
    mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    data = data.copy()
    data[ends[keep]] = 0x20
    out = data[mask].tobytes()
    size = np.concatenate([[0], np.cumsum(np.where(keep, ends - starts + 1, 0))])
    at = size[first]
    texts = [out[lo : max(lo, hi - 1)] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
    n_hit = np.concatenate([[0], np.cumsum(hit)])
    columns = [*batch.columns, pa.array(np.diff(first), pa.int64()), pa.array(np.diff(n_hit[first]), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
    names = [*batch.schema.names, "n_words", "n_removed", "kept_text"]
    if spans:
        runs = []
        for lo, hi in zip(first[:-1], first[1:]):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]]))).tolist() if n_hit[hi] > n_hit[lo] else []
            runs.append([{"first": x, "end": y} for x, y in zip(edge[0::2], edge[1::2])])
        columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))))
        names.append("removed")
    if whole is not None:
        columns.append(whole)
        names.append("cut_text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats over a documents table."""
    return remove_repeats(docs.select("doc_id", "text"), spans=False).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))

"""Removal of repeated byte strings by prefix-free parsing.

Every string of `size` bytes that occurs twice or more, in one text or two, is removed from wherever it is
covered by one; matches never cross texts. The parse makes this affordable on repetitive text:

1. Parse. A rolling hash over W bytes triggers a cut about every P bytes, so equal stretches are cut alike. A
   phrase is what lies between two cuts, with the W bytes that triggered the first; a count-min sketch over all
   phrases (see sketch.py; it grows with the table) is the dictionary's occurrence filter: a window that holds a
   phrase of one occurrence is unique.
2. Parse contexts. The windows that start in one phrase and whose next cut is within NEAR bytes form a cell.
   Its unit is all the bytes its windows touch; its context is the NEAR bytes after the cut, which all its
   windows hold. Units and contexts are counted exactly (96 bits): a unit seen twice settles its whole cell.
3. Edges. Where a repeated stretch begins or ends, contexts repeat and units don't. Only there, windows are
   compared one by one: those of unsettled cells with a repeated context, and of one representative of
   each unit whose context occurs elsewhere too. Windows without a cut nearby form their own class and are compared
   one by one after the sketch.

Ranking all suffixes in one order would gather the parse in one place. Only equality at depth `size` matters
here, so the order of dictionary and parse suffixes is replaced by their equality classes, which partition by
hash. Rows are dealt to buckets by a hash of id and text; buckets send distinct classes to hash ranges and get
counts back, so no key, however common, gathers in one task.

Defined results: a null text is empty; texts shorter than `size` lose nothing; ids play no part, so ties,
null ids and repeated rows are plain occurrences (a repeated row of `size` bytes or more is removed in both
places); an empty table gives an empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import sketch
from .kernels import U64
from .staging import cut, fresh, text_bytes

MADE = ("n_bytes", "n_removed", "n_spans", "kept", "spans")

SIZE = 200
W, P, NEAR = 16, 24, 100
SLICE = 2 << 20
MOST = 2**31 - 1

_rng = np.random.default_rng(20_251_126)
_TABLES = [_rng.integers(0, 2**64, 256, np.uint64) for _ in range(2)]
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base or more; kept for the next batch of texts."""
    have = _known.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, SLICE + SLICE // 8), U64)
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 2**64))
            done += step
        _known[base] = have = out
    return have


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    own = _TABLES[which][data]
    own *= _powers(_BASES[which], len(data))[: len(data)]
    np.cumsum(own, out=sums[1:])
    return sums


class Hashes:
    """Two 64-bit hashes of any stretch of the bytes, by prefix sums; the second is made when first needed."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, [_sums(data, 0), None]

    def of(self, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
        if self.sums[which] is None:
            self.sums[which] = _sums(self.data, which)
        sums, inverse = self.sums[which], _powers(pow(_BASES[which], -1, 2**64), len(self.data) + 1)
        out = sums[hi]
        out -= sums[lo]
        out *= inverse[lo]
        out += (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15)
        return K.mix(out)

    def pair(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.of(lo, hi), (self.of(lo, hi, 1) >> U64(32)).astype(np.uint32)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges lo..hi-1, and the range that each is of."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


class Parse:
    """Cuts, phrases, cells and far windows of a batch of texts."""

    def __init__(self, texts, size: int):
        self.size = size
        self.data, self.at = K.lay_out(texts)
        begins, ends = self.at[:-1], self.at[1:] - 1
        lanes = np.ascontiguousarray(np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1), writeable=False)).view(U64).ravel()
        h = lanes[:-8] * U64(0x9E3779B97F4A7C15) + lanes[8:] * U64(0xC2B2AE3D27D4EB4F)
        h ^= h >> U64(29)
        h *= U64(0x94D049BB133111EB)
        cuts = np.flatnonzero((h >> U64(32)) < U64(2**32 // P)) + W
        del lanes, h
        doc = np.searchsorted(self.at, cuts, side="right") - 1
        # a cut at the very end of a text cuts nothing; the trigger must lie in the text
        ok = (doc < len(begins)) & (cuts - W >= begins[np.minimum(doc, len(begins) - 1)]) & (cuts < ends[np.minimum(doc, len(begins) - 1)]) if len(begins) else np.zeros(len(cuts), bool)
        cuts, doc = cuts[ok], doc[ok]
        # phrases: from one cut to the next of the same text
        same = doc[1:] == doc[:-1]
        self.phrase_at = np.flatnonzero(same)
        self.cuts = cuts
        # cells: from the text's start, or W before a cut, to W before the next cut, or the text's end
        lo = np.concatenate([begins, cuts - W])
        order = np.lexsort((np.concatenate([np.zeros(len(begins), np.int8), np.ones(len(cuts), np.int8)]), lo))
        own = np.concatenate([np.arange(len(begins)), doc])[order]
        lo = lo[order]
        last = np.ones(len(lo), bool)
        last[:-1] = own[1:] != own[:-1]
        hi = np.concatenate([lo[1:], [0]]) if len(lo) else lo
        stop = ends[own] - size + 1
        anchor = np.where(last, np.iinfo(np.int64).max // 2, hi + W)
        hi = np.minimum(np.where(last, ends[own], hi), stop)
        near = np.minimum(np.maximum(lo, anchor - NEAR), np.maximum(hi, lo))
        keep = hi > near
        self.lo, self.hi, self.anchor, self.end = near[keep], hi[keep], anchor[keep], ends[own][keep]
        far = np.minimum(near, hi)
        self.far, _ = spread(lo, far)
        self.hash: Hashes | None = None

    def keys(self) -> np.ndarray:
        """What the sketch counts: the hashes of all phrases, then those of all far windows."""
        own = Hashes(self.data)
        k = self.phrase_at
        return np.concatenate([own.of(self.cuts[k] - W, self.cuts[k + 1]), own.of(self.far, self.far + self.size)])

    def drop_unique(self, repeated: np.ndarray) -> None:
        """Forget cells whose windows all hold a phrase of one occurrence, and far windows seen once, by what is
        known of each key. The hashes that the rest needs are made from here on."""
        self.hash = Hashes(self.data)
        unique = np.zeros(len(self.cuts) + 1, np.int64)
        unique[self.phrase_at + 1] = ~repeated[: len(self.phrase_at)]
        unique = np.cumsum(unique)
        first = np.searchsorted(self.cuts, self.anchor)  # the cut at the anchor
        past = np.searchsorted(self.cuts, self.anchor + NEAR, side="right") - 1  # the last cut in the context
        ok = unique[np.maximum(past, first)] == unique[first]
        self.lo, self.hi, self.anchor, self.end = self.lo[ok], self.hi[ok], self.anchor[ok], self.end[ok]
        self.far = self.far[repeated[len(self.phrase_at) :]]

    def far_hashes(self):
        return self.hash.pair(self.far, self.far + self.size)

    def units(self):
        return self.hash.pair(self.lo, np.minimum(self.hi - 1 + self.size, self.end))

    def contexts(self):
        return self.hash.pair(self.anchor, self.anchor + NEAR)


def parses(table: pa.Table, text: str, size: int, answers: pa.Table | None = None, grid: sketch.Grid | None = None):
    """Pieces and parses of a bucket's texts and, without answers, its distinct keys; with them, what is unique
    is dropped and the hashes of one piece are held at a time."""
    made = [(piece, Parse(piece.column(piece.schema.get_field_index(text)), size)) for piece in cut(table.to_batches(), text, SLICE)]
    found = [parse.keys() for _, parse in made]
    keys, place, here = sketch.distinct(np.concatenate([np.zeros(0, U64), *found]))
    if answers is None:
        return keys
    repeated = (here | sketch.bits_told(answers, sketch.SKETCH, keys, grid))[place] if len(keys) else np.zeros(0, bool)

    def each():
        at = 0
        for k, own in enumerate(found):
            piece, parse = made[k]
            made[k] = None
            parse.drop_unique(repeated[at : at + len(own)])
            at += len(own)
            yield piece, parse

    return each()


def counted(a: np.ndarray, b: np.ndarray, times: np.ndarray | None = None):
    """Distinct (a, b) in order, how often each occurs, the first place of each, and each one's number."""
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    n = np.bincount(number, times, new.sum()).astype(np.int64)
    return sa[new], sb[new], n, order[new], number


_PACKET = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("times", pa.binary())])
_PACKET_DDL = "shard int, kind int, bucket long, a binary, b binary, times binary"
UNIT, CONTEXT, WINDOW = 1, 2, 3


def packets(bucket: int, grid: sketch.Grid, kinds: dict[int, tuple]) -> pa.Table:
    """Distinct keys of each kind with their counts, by hash range."""
    rows = {f.name: [] for f in _PACKET}
    for kind, (a, b, times) in kinds.items():
        names, begin = np.unique(grid.shard_of(a), return_index=True)
        for k, lo, hi in zip(names.tolist(), begin, [*begin[1:], len(a)]):
            for name, v in zip(rows, (k, kind, bucket, a[lo:hi].tobytes(), b[lo:hi].tobytes(), np.minimum(times[lo:hi], MOST).astype(np.int32).tobytes())):
                rows[name].append(v)
    return pa.Table.from_pydict(rows, schema=_PACKET)


def answer(table: pa.Table) -> pa.Table:
    """For each key sent: its total count; for units negative unless the sender is the first that has it.
    Windows only need to know of a second occurrence: one bit each."""
    out = {f.name: [] for f in sketch.ANSWER}
    kinds, buckets = table.column("kind").to_numpy(), table.column("bucket").to_numpy()
    columns = [[np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("a", U64), ("b", np.uint32), ("times", np.int32))]
    shard = table.column("shard")[0].as_py()
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(buckets[own], kind="stable")]
        a, b, times = ([c[k] for k in own] for c in columns)
        _, _, total, first, number = counted(np.concatenate(a), np.concatenate(b), np.concatenate(times))
        got = np.minimum(total, MOST).astype(np.int32)[number]
        if kind == UNIT:
            leads = np.zeros(len(number), bool)
            leads[first] = True
            got[~leads] *= -1
        at = 0
        for k, x in zip(own, a):
            part = got[at : at + len(x)]
            at += len(x)
            for name, v in zip(out, (int(buckets[k]), kind, shard, np.packbits(part > 1).tobytes() if kind == WINDOW else part.tobytes())):
                out[name].append(v)
    return pa.Table.from_pydict(out, schema=sketch.ANSWER)


def times_told(answers: pa.Table, kind: int) -> np.ndarray:
    """The counts told of a bucket's distinct keys of a kind, in their order."""
    return np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(t, np.int32) for _, t in sketch.answers_of(answers, kind))])


class Bucket:
    """One bucket's cells and far windows, numbered over all its texts; parsed slice by slice, once.
    windows: whether to hash the windows of all cells too."""

    def __init__(self, table: pa.Table, text: str, size: int, answers: pa.Table, grid: sketch.Grid, windows: bool):
        self.slices = []
        units, contexts, own, far = ([] for _ in range(4))
        for piece, parse in parses(table, text, size, answers, grid):
            units.append(parse.units())
            contexts.append(parse.contexts())
            if windows:
                starts, cell = spread(parse.lo, parse.hi)
                own.append((cell, starts, *parse.hash.pair(starts, starts + size)))
                far.append((parse.far, *parse.far_hashes()))
                self.slices.append((piece, parse.data, parse.at, parse.lo, parse.hi))
        empty = [(np.zeros(0, U64), np.zeros(0, np.uint32))]
        self.unit, self.context = (counted(*map(np.concatenate, zip(*(x or empty)))) for x in (units, contexts))
        self.own, self.far = own, far

    def settle(self, answers: pa.Table) -> np.ndarray:
        """For each cell: is it settled. From then on, only the windows to be compared one by one are held."""
        unit, context = times_told(answers, UNIT), times_told(answers, CONTEXT)
        n_unit, n_context = np.abs(unit)[self.unit[4]], context[self.context[4]]
        settled = n_unit > 1
        first = np.zeros(len(settled), bool)
        first[self.unit[3]] = unit > 0
        # counts stop at MOST, where equal ones prove nothing
        compared = np.where(settled, first & ((n_context > n_unit) | (n_context == MOST)), n_context > 1)
        at = 0
        self.starts, a, b = [], [], []
        for (cell, starts, x, y), (far, far_x, far_y), (*_, lo, _) in zip(self.own, self.far, self.slices):
            keep = compared[at : at + len(lo)][cell]
            at += len(lo)
            self.starts.append(np.concatenate([starts[keep], far]))
            a += [x[keep], far_x]
            b += [y[keep], far_y]
        self.own = self.far = None
        self.windows = counted(np.concatenate(a) if a else np.zeros(0, U64), np.concatenate(b) if b else np.zeros(0, np.uint32))
        return settled


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, spans: bool = True) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans, kept (the remaining bytes) and, if asked for,
    spans: the removed runs as structs of first byte and end."""
    if size < 2 * NEAR:
        raise ValueError(f"size must be {2 * NEAR} at least")
    docs = fresh(docs, *MADE)
    grid = sketch.grid(docs.sparkSession, text_bytes(docs, text), P - 6)
    dealt = sketch.dealt(docs, id_column, text, grid, size)

    def send_keys(table: pa.Table) -> pa.Table:
        return sketch.packets(table.column("__bucket")[0].as_py(), parses(table, text, size), grid)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PACKET.empty_table()
        own = Bucket(table, text, size, answers, grid, False)
        return packets(table.column("__bucket")[0].as_py(), grid, {UNIT: own.unit[:3], CONTEXT: own.context[:3]})

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PACKET.empty_table()
        own = Bucket(table, text, size, answers, grid, True)
        own.settle(answers)
        return packets(table.column("__bucket")[0].as_py(), grid, {WINDOW: own.windows[:3]})

    names = docs.columns
    out = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in MADE[:3]), T.StructField("kept", T.BinaryType())])
    if spans:
        out = out.add("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Bucket(table, text, size, answers, grid, True)
        settled = own.settle(answers)
        a, _, _, _, number = own.windows
        repeated = sketch.bits_told(answers, WINDOW, a, grid)[number] if len(a) else np.zeros(0, bool)
        cell, window, made = 0, 0, []
        for (piece, data, at, lo, hi), starts in zip(own.slices, own.starts):
            known = settled[cell : cell + len(lo)]
            cell += len(lo)
            hit = starts[repeated[window : window + len(starts)]]
            window += len(starts)
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, np.concatenate([hit, lo[known]]), 1)
            np.add.at(step, np.concatenate([hit + size, hi[known] - 1 + size]), -1)
            made.append(_cut_out(piece.select(names), data, at, np.cumsum(step[:-1]) > 0, spans))
        return pa.Table.from_batches(made)

    def asked(f, told: DataFrame) -> DataFrame:
        sent = dealt.groupBy("__bucket").cogroup(told.groupBy("bucket")).applyInArrow(f, _PACKET_DDL)
        return sketch.by_shard(sent, grid).applyInArrow(answer, sketch.ANSWER_DDL).repartition(grid.buckets, "bucket")

    keys = dealt.groupBy("__bucket").applyInArrow(send_keys, sketch.PACKET_DDL)
    told = sketch.by_shard(keys, grid).applyInArrow(sketch.merger(grid), sketch.ANSWER_DDL).repartition(grid.buckets, "bucket")
    for f in (send, send_windows):
        told = told.unionByName(asked(f, told))
    return dealt.groupBy("__bucket").cogroup(told.groupBy("bucket")).applyInArrow(judge, out)


def _cut_out(batch, data, at, gone, spans):
    body = np.ones(len(data), bool)
    body[at[1:] - 1] = False
    body[at[-1] :] = False
    keep = body & ~gone
    size = np.concatenate([[0], np.cumsum(keep)])[at]
    text = data[keep].tobytes()
    kept = [text[lo:hi] for lo, hi in zip(size[:-1].tolist(), size[1:].tolist())]
    n_bytes = np.diff(at) - 1
    edge = np.diff(np.concatenate([[0], (gone & body).astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # the byte after each text is never removed, so a run ends within its text
    doc = np.searchsorted(at, first, side="right") - 1
    columns = [*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(n_bytes - np.diff(size), pa.int64()), pa.array(np.bincount(doc, minlength=len(n_bytes)), pa.int64()), pa.array(kept, pa.binary())]
    if spans:
        runs = [[] for _ in kept]
        for k, lo, hi in zip(doc.tolist(), (first - at[doc]).tolist(), (end - at[doc]).tolist()):
            runs[k].append({"first": lo, "end": hi})
        columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))))
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_bytes", "n_removed", "n_spans", "kept", *["spans"] * spans])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    made = remove_repeats(docs.select("doc_id", "text"), spans=False)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

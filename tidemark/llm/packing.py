"""Best-fit packing by patterns: fit repeat counts of few-document patterns, round, pack the residuals.

The number of pieces of each length is a histogram of at most `length` counts, the only thing the driver
plans on, however large the corpus. Patterns are the ways in which two or three lengths fill a sequence
exactly. Their repeat counts are fitted to the histogram by non-negative least squares (multiplicative
updates, which keep every count non-negative), rounded down and cut to what is there; what is left, the
residuals, is packed by filling sequences with the longest pieces that fit, many equal sequences at a time. How
much of the fit is best left to the residuals differs: it is rounded down at each of SHARES, and the rounding with
the fewest sequences is the plan. The plan says which ranks of each length go to which sequences and where; pieces
find theirs by rank.

Ranks need no group of one length in one place: pieces are numbered within (length, salt), and the counts
of the salts give each its offset.

Defined results: a null or empty text is a document of the end token alone; a very long one is many pieces; a null
id is kept, and ranks first; repeated rows are packed separately, ties of id and piece in any order, as equal
pieces may change places; an empty table gives an empty result. Only id and text are read, so names of other
columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .staging import staged

ROUNDS = 400
#: Parts of the fitted repeats that are rounded down, one by one and summed.
SHARES, SUMMED = (1.0, 0.75, 0.5), (0.5, 0.25, 0.05)


def patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """Rows of three lengths, of which the last may be 0, that fill the room exactly."""
    here = np.zeros(room + 1, bool)
    here[lengths] = True
    own = np.flatnonzero(here[:room])
    pairs = [(a, room - a, 0) for a in own if a <= room - a and here[room - a]]
    out = [np.array(pairs, np.int64).reshape(-1, 3)]
    for a in own:
        b = own[(own >= a)]
        c = room - a - b
        ok = c >= b
        b, c = b[ok], c[ok]
        ok = here[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def fitted(rows: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' use of each length near to its count."""
    if not len(rows):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0
    weight = 1 / np.maximum(target, 1)
    x = np.full(len(rows), target.sum() / max(1, 3 * len(rows)))
    up = (target * weight)[rows].sum(axis=1)
    for _ in range(rounds):
        use = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), len(counts))
        use[0] = 0
        x *= up / np.maximum((use * weight)[rows].sum(axis=1), 1e-12)
    return x


def plan(counts: np.ndarray, room: int) -> dict[str, np.ndarray]:
    """Segments of the ranks of each length: from rank `first` on, `size` pieces, `each` to a sequence, go to
    sequences from `sequence` on, at `offset`; fitted: whether the sequences are of a fitted pattern. counts[l]:
    pieces of length l. Of the roundings of the fit, the one with the fewest sequences (of equals the one that
    keeps most of the fit); one that rounds every pattern away counts only if all do."""
    left = counts.astype(np.int64).copy()
    left[[0, room]] = 0
    rows = patterns(np.flatnonzero(left), room)
    times = fitted(rows, left)
    order = np.argsort(-times, kind="stable")
    summed = np.zeros(len(times))
    summed[order] = np.cumsum(times[order])
    made = [_rounded(counts, room, rows, np.floor(share * times).astype(np.int64)) for share in SHARES]
    # a fit spread over many patterns rounds to nothing one by one: its running sum is rounded instead
    made += [_rounded(counts, room, rows, (np.floor(share * summed) - np.floor(share * (summed - times))).astype(np.int64)) for share in SUMMED]
    return min(made, key=lambda m: (not m[0]["fitted"].any(), m[1]))[0]


def _rounded(counts: np.ndarray, room: int, rows: np.ndarray, times: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """The plan with so many repeats of each pattern, as far as pieces are there, and its number of sequences."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    out = {k: [] for k in ("length", "first", "size", "each", "sequence", "offset", "fitted")}
    next_sequence = 0

    def place(parts: list[tuple[int, int]], times: int, fitted: bool = False) -> None:
        nonlocal next_sequence
        offset = 0
        for length, each in parts:
            for k, v in zip(out, (length, used[length], each * times, each, next_sequence, offset, fitted)):
                out[k].append(int(v))
            used[length] += each * times
            left[length] -= each * times
            offset += length * each
        next_sequence += times

    if left[room]:
        place([(room, 1)], int(left[room]))
    for k in np.argsort(-times, kind="stable"):
        if times[k] < 1:
            break
        kinds, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = min(times[k], *(left[kinds] // each))
        if n > 0:
            place(list(zip(kinds.tolist(), each.tolist())), int(n), True)
    while left.any():
        free, parts = room, []
        own = left.copy()
        while free:
            fit = np.flatnonzero(own[1 : free + 1])
            if not len(fit):
                break
            length = int(fit[-1]) + 1
            each = int(min(own[length], free // length))
            parts.append((length, each))
            own[length] = 0
            free -= length * each
        place(parts, min(int(left[length]) // each for length, each in parts))
    return {k: np.array(v, np.int64) for k, v in out.items()}, next_sequence


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    return salted.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("skip") + F.col("own")).drop("salt", "own", "skip")


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = tokens.VOCABULARY, end: int | None = tokens.END, length: int = tokens.LENGTH, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset."""
    ddl = tokens.PIECE_DDL + (", ids binary" if ids else "")
    cast = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = staged(cast.mapInArrow(tokens.pieces("doc_id", "text", vocabulary, end, length, ids), ddl), "pieces")
    counts = np.zeros(length + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    segments = plan(counts, length)
    order = np.lexsort((segments["first"], segments["length"]))
    segments = {k: v[order] for k, v in segments.items()}
    reach = int(counts.max(initial=0)) + 1
    keys = segments["length"] * reach + segments["first"]

    def assign(batches):
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            rank = batch.column(at["rank"]).to_numpy(zero_copy_only=False)
            own = batch.column(at["length"]).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, own * reach + rank, side="right") - 1
            place = rank - segments["first"][k]
            each = segments["each"][k]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array(segments["sequence"][k] + place // each), pa.array(segments["offset"][k] + place % each * own)], names=[*names, "sequence_id", "offset"])

    salts = max(64, int(counts.sum() // 200_000))
    lined = ranked(pieces, salts).select(*pieces.columns, "rank")
    return lined.mapInArrow(assign, f"{ddl}, sequence_id long, offset long")

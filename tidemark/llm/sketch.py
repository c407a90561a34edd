"""Count-min sketch of 64-bit keys that grows with the data: its ranges lie with reducers, never with the driver.

Rows of a table are dealt to buckets. A bucket sends its distinct keys to the hash ranges (shards) they belong to,
each key as its cell in the first row, as a byte-coded gap, and one byte for the second row. A shard merges what
all buckets sent, counts both rows and answers each bucket with one bit for each of its keys, in order: was the
smaller of the two cells hit twice or more? Estimates only err upwards, so no key of two buckets is missed; a
bucket knows its own repeats. Cells are at least CELLS a key at every size, so the share of single keys that pass
doesn't grow with the table.

The second row places a key within the GROUP cells around its first one, so one order serves both rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U64

CELLS = 4
GROUP = 256
#: Bytes of text in a bucket: BUCKET, and beyond about 30 GB GROWTH times the root of the table's size, so that
#: what one bucket sends to one shard stays about as large (packets grow with the table, not with its square).
BUCKET, GROWTH, LEAST = 8 << 20, 46, 256 << 10

PACKET = pa.schema([("bucket", pa.int64()), ("shard", pa.int32()), ("gaps", pa.binary()), ("rest", pa.binary())])
PACKET_DDL = "bucket long, shard int, gaps binary, rest binary"
ANSWER = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("told", pa.binary())])
ANSWER_DDL = "bucket long, kind int, shard int, told binary"
SKETCH = 0


class Grid(NamedTuple):
    """buckets of rows, 2**shard_bits ranges of keys, 2**cell_bits cells a row in each; low: how many bytes of
    a gap are sent as they are."""

    buckets: int
    shard_bits: int
    cell_bits: int
    low: int

    @property
    def shards(self) -> int:
        return 1 << self.shard_bits

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.shard_bits)).astype(np.int64)


def sized(size: int, per_key: int, least: int = 1) -> Grid:
    """The grid for so many bytes with about one key in per_key bytes, and `least` buckets if there are bytes for them."""
    buckets = max(1, min(least, -(-size // LEAST)), -(-size // max(BUCKET, int(GROWTH * size**0.5))))
    shard_bits = max(1, buckets.bit_length() - 1)
    keys = max(1, size // per_key)
    cell_bits = max(GROUP.bit_length() - 1, int(np.ceil(np.log2(CELLS * keys / (1 << shard_bits)))))
    gap = 2.0 ** (cell_bits + shard_bits) * buckets / keys
    return Grid(buckets, shard_bits, cell_bits, sum(gap >= x for x in (2**7, 2**15, 2**23)))


def grid(spark: SparkSession, size: int, per_key: int) -> Grid:
    return sized(size, per_key, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(docs: DataFrame, id_column: str, text: str, own: Grid, least: int = 1) -> DataFrame:
    """docs with __bucket, by a hash of id and text. Texts below `least` bytes have no keys and may lie
    anywhere: they are spread by partition too, so that a third of all rows may be null."""
    content = F.xxhash64(F.col(id_column), F.col(text))
    short = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) < least
    bucket = F.pmod(F.when(short, content + F.spark_partition_id()).otherwise(content), F.lit(own.buckets))
    return docs.withColumn("__bucket", bucket).repartition(own.buckets, "__bucket")


def by_shard(packets: DataFrame, own: Grid):
    return packets.repartition(own.shards, "shard").groupBy("shard")


def _gaps(values: np.ndarray, low: int) -> tuple[bytes, bytes]:
    """Sorted values as gaps: the upper part in bytes, where 255 stands for 255 more and a smaller byte ends
    it; the `low` lower bytes plane by plane."""
    gaps = np.diff(values, prepend=0)
    high = gaps >> (8 * low)
    ends = np.cumsum(high // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = high % 255
    return out.tobytes(), b"".join(((gaps >> (8 * k)) & 255).astype(np.uint8).tobytes() for k in range(low))


def _values(coded, planes: np.ndarray, low: int) -> np.ndarray:
    raw = np.frombuffer(coded, np.uint8)
    gaps = np.diff(np.cumsum(raw, dtype=np.int64)[raw != 255], prepend=0) << (8 * low)
    for k in range(low):
        gaps |= planes[k].astype(np.int64) << (8 * k)
    return np.cumsum(gaps)


def packets(bucket: int, keys: np.ndarray, own: Grid) -> pa.Table:
    """What a bucket sends for its sorted distinct keys."""
    shard = own.shard_of(keys)
    cells = ((keys << U64(own.shard_bits)) >> U64(64 - own.cell_bits)).astype(np.int64)
    second = (keys & U64(GROUP - 1)).astype(np.uint8)
    names, begin = np.unique(shard, return_index=True)
    rows = {f.name: [] for f in PACKET}
    for k, lo, hi in zip(names.tolist(), begin, [*begin[1:], len(keys)]):
        gaps, low = _gaps(cells[lo:hi], own.low)
        for name, v in zip(rows, (bucket, k, gaps, low + second[lo:hi].tobytes())):
            rows[name].append(v)
    return pa.Table.from_pydict(rows, schema=PACKET)


def merger(own: Grid, counts: bool = False):
    """The function of a shard: merges its packets and answers each. counts: after the bits come, for each key
    whose bit is set, one byte with the binary order of its estimated count."""

    def merge(table: pa.Table) -> pa.Table:
        first, second = [], []
        for gaps, rest in zip(table.column("gaps"), table.column("rest")):
            planes = np.frombuffer(rest.as_buffer(), np.uint8).reshape(own.low + 1, -1)
            cells = _values(gaps.as_buffer(), planes, own.low)
            first.append(cells)
            second.append((cells & ~(GROUP - 1)) | planes[-1])
        at = np.cumsum([0, *map(len, first)])
        estimate = None
        for cells in (np.concatenate(first), np.concatenate(second)):
            seen = np.zeros(1 << own.cell_bits, np.uint32)
            np.add.at(seen, cells, 1)
            estimate = seen[cells] if estimate is None else np.minimum(estimate, seen[cells])
        twice = estimate >= 2
        order = np.log2(estimate).astype(np.uint8) if counts else None
        told = []
        for lo, hi in zip(at[:-1], at[1:]):
            bits = np.packbits(twice[lo:hi]).tobytes()
            told.append(bits + order[lo:hi][twice[lo:hi]].tobytes() if counts else bits)
        n = table.num_rows
        return pa.Table.from_pydict({"bucket": table.column("bucket"), "kind": np.full(n, SKETCH, np.int32), "shard": table.column("shard"), "told": told}, schema=ANSWER)

    return merge


def answers_of(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(shard, answer) of a kind, by shard."""
    return sorted((s, t) for k, s, t in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("told").to_pylist()) if k == kind)


def sizes_of(keys: np.ndarray, own: Grid) -> dict[int, int]:
    names, n = np.unique(own.shard_of(keys), return_counts=True)
    return dict(zip(names.tolist(), n.tolist()))


def bits_told(answers: pa.Table, kind: int, keys: np.ndarray, own: Grid) -> np.ndarray:
    """One bit for each of a bucket's sorted distinct keys."""
    sizes = sizes_of(keys, own)
    parts = [np.unpackbits(np.frombuffer(t, np.uint8), count=sizes[s]) for s, t in answers_of(answers, kind)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def orders_told(answers: pa.Table, keys: np.ndarray, own: Grid) -> np.ndarray:
    """For each key 0 if no other bucket seems to have it, else the binary order of its count."""
    sizes, parts = sizes_of(keys, own), []
    for s, t in answers_of(answers, SKETCH):
        raw = np.frombuffer(t, np.uint8)
        part = np.unpackbits(raw[: -(-sizes[s] // 8)], count=sizes[s])
        part[part > 0] = raw[-(-sizes[s] // 8) :]
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and which of them occur twice or more here."""
    own, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return own, place, n > 1

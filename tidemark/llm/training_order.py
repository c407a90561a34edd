"""Training-order materialisation: every token sequence gets a global slot, and shards hold the slots in order.

Sequences are written once, ordered by id, a hash of the text and the place in it, and numbered densely in that
order. A keyed Feistel network permutes the numbers; a result beyond the last number walks the cycle until it falls
within. The order is thus a pure function of key and number, the same however the input is partitioned: nothing is
sorted at random and any slot can be found without the others. Slots are dealt to ranges of one width, and each range
writes a file of shards of `per_shard` records of one fixed stride, so slot s is at byte (s % per_shard) * stride
of shard s // per_shard. A reader goes through the files in order and can begin at any slot.

A record: doc_id (int64), piece (int32), number of ids (int32), ids (uint16), zeros up to the stride.

Defined results: a null or empty text is a sequence of the end token alone; a null doc_id comes first and is written
as -2**63; repeated rows are sequences of their own, with neighbouring numbers; a long text is many sequences; an
empty table gives no shard; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens
from .staging import staged, text_bytes

KEY = 20_251_126
PER_SHARD = 1024
#: Up to so many ranges, the number each begins with travels in the closure (8 bytes each).
FEW_RANGES = 20_000
RANGE_BYTES = 64 << 20
SHARDS_A_FILE = 32
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n", "<i4")])
NULL = -(2**63)
ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n-1 applied to x, by a keyed balanced Feistel network with cycle-walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = K.U64((1 << half) - 1)
    keys = K.mix(np.arange(1, ROUNDS + 1, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15) + K.U64(key % 2**64))

    def once(v):
        left, right = v >> K.U64(half), v & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right + k) & mask)
        return (left << K.U64(half)) | right

    out = once(x.astype(K.U64))
    while (beyond := out >= K.U64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def stride(length: int) -> int:
    return HEAD.itemsize + 2 * length


def sequences(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = tokens.VOCABULARY, end: int | None = tokens.END, length: int = tokens.LENGTH) -> DataFrame:
    """The pieces of all texts, written in the order of their numbers: by id (null first), a hash of the text and
    the place in it, however the input is partitioned. Rows equal in both are equal sequences; those of one input
    partition stay together, so that many of them still spread over ranges."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = own.withColumn("mark", F.xxhash64("text")).withColumn("origin", F.spark_partition_id())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(own) // RANGE_BYTES))
    ranged = keyed.repartitionByRange(parts, "doc_id", "mark", "origin").sortWithinPartitions("doc_id", "mark")
    made = ranged.select("doc_id", "text").mapInArrow(tokens.pieces("doc_id", "text", vocabulary, end, length, True), tokens.PIECE_DDL + ", ids binary")
    return staged(made.select("doc_id", "piece", "ids").withColumn("range", F.spark_partition_id()), "sequences", compression="zstd", maxRecordsPerFile=0)


def shards(docs: DataFrame, id_column: str = "doc_id", text: str = "text", key: int = KEY, per_shard: int = PER_SHARD, vocabulary: str = tokens.VOCABULARY, end: int | None = tokens.END, length: int = tokens.LENGTH, few_ranges: int = FEW_RANGES, path: str | None = None) -> DataFrame:
    """Writes the shards to path (a folder of the shared one if none is named) and returns them as read back: one row
    a shard (shard, first_slot, n_slots, payload); each file holds a range of shards in order."""
    rows = sequences(docs, id_column, text, vocabulary, end, length).select("doc_id", "piece", "ids", "range", F.col("_metadata.row_index").alias("line"))
    # one number for each range reaches the driver; the numbers go back to tasks while they are few
    found = sorted((r["range"], r["count"]) for r in rows.groupBy("range").count().toLocalIterator())
    ends = np.cumsum([n for _, n in found])
    total = int(ends[-1]) if found else 0
    skips = list(zip([k for k, _ in found], [0, *ends[:-1].tolist()]))
    if few := len(found) <= few_ranges:
        before = np.zeros(skips[-1][0] + 1 if found else 1, np.int64)
        for k, skip in skips:
            before[k] = skip
        rows = rows.withColumn("skip", F.lit(0).cast("long"))
    else:
        before = np.zeros(1, np.int64)
        rows = rows.join(docs.sparkSession.createDataFrame(skips, "range int, skip long"), "range")

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, skip: pd.Series, line: pd.Series) -> pd.Series:
        begins = before[part.to_numpy()] if few else skip.to_numpy()
        return pd.Series(feistel(begins + line.to_numpy(), total, key))

    size = stride(length)

    def write(batches):
        shard, first, n, held = None, None, 0, None
        schema = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_slots", pa.int64()), ("payload", pa.binary())])

        def done():
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([first]), pa.array([n]), pa.array([bytes(held[: n * size])], pa.binary())], schema=schema)

        for batch in batches:
            slots, docs_, pieces_, ids_ = (batch.column(k) for k in range(4))
            heads = np.zeros(batch.num_rows, HEAD)
            heads["doc_id"] = docs_.fill_null(NULL).to_numpy()
            heads["piece"] = pieces_.to_numpy()
            heads["n"] = pc.binary_length(ids_).to_numpy() // 2
            for slot, head, ids in zip(slots.to_pylist(), heads, ids_):
                if slot // per_shard != shard:
                    if n:
                        yield done()
                    shard, first, n, held = slot // per_shard, slot, 0, bytearray(per_shard * size)
                record = head.tobytes() + ids.as_buffer().to_pybytes()
                held[n * size : n * size + len(record)] = record
                n += 1
        if n:
            yield done()

    n_shards = -(-total // per_shard)
    parts = max(1, min(n_shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // SHARDS_A_FILE))))
    # slots are a permutation, so ranges of one width are of one size, and no sample has to find their bounds
    numbered = rows.select(slot_of("range", "skip", "line").alias("slot"), "doc_id", "piece", "ids")
    own_range = F.expr(f"cast(slot div {per_shard} * {parts} div {max(1, n_shards)} as int)")
    ranged = numbered.repartitionById(parts, own_range).sortWithinPartitions("slot")
    made = ranged.mapInArrow(write, "shard long, first_slot long, n_slots long, payload binary")
    return staged(made, "shards", path, compression="zstd", maxRecordsPerFile=0)


def read_slot(payload: bytes, slot: int, per_shard: int = PER_SHARD, length: int = tokens.LENGTH) -> tuple[int | None, int, np.ndarray]:
    """doc_id, piece and ids of one slot, by one seek into its shard."""
    at = slot % per_shard * stride(length)
    doc, piece, n = np.frombuffer(payload, HEAD, 1, at)[0].tolist()
    return (None if doc == NULL else doc), piece, np.frombuffer(payload, "<u2", n, at + HEAD.itemsize)


def contents(made: DataFrame, per_shard: int = PER_SHARD, length: int = tokens.LENGTH, first: int = 0) -> DataFrame:
    """What shards hold from one slot on, read back: one row a slot. The scan skips files and row groups of
    shards before it, so a run resumes where it stopped."""
    size = stride(length)
    asked = made.where(F.col("shard") >= first // per_shard).select("first_slot", "payload")
    schema = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in ("slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids_crc32")])
    record = np.dtype([*HEAD.descr, ("ids", "<u2", (length,))])

    def read(batches):
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = np.frombuffer(payload.as_buffer(), record)[max(0, first - begin) :]
                slot = np.arange(len(held)) + max(first, begin)
                crc = [zlib.crc32(ids[:n].astype("<u4").tobytes()) for ids, n in zip(held["ids"], held["n"].tolist())]
                doc = pa.array(held["doc_id"].astype(np.int64), mask=held["doc_id"] == NULL)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * size), doc, pa.array(held["piece"].astype(np.int32)), pa.array(held["n"].astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    return asked.mapInArrow(read, "slot long, shard long, byte_offset long, doc_id long, piece int, n_tokens long, ids_crc32 long")


def resumed(spark: SparkSession, path: str, first: int = 0, per_shard: int = PER_SHARD, length: int = tokens.LENGTH) -> DataFrame:
    """contents() of shards written earlier."""
    return contents(spark.read.parquet(path), per_shard, length, first)

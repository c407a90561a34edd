"""N-gram Jaccard join: a grouped prefix join, exact at the threshold.

A text's set holds the hashes of its distinct shingles (ASCII lower-cased words). Texts with one set are one
class. Steps:

1. A count-min sketch over all texts (see sketch.py; it grows with the table) tells shingles that may occur in two
   texts from those that cannot. The second kind can be in no overlap: it counts towards a set's size and prefix,
   and is otherwise left out. A class whose prefix holds no other shingle joins nothing and goes no further, which
   is most of them.
2. Order: shingles of one text first, then by the binary order of the sketch's count, then by hash. Classes with
   identical prefix (its shared part) and size collapse into one group. Groups are posted under their prefix shingles.
3. First round: within each group and each posting list, members are verified against leaders (the class
   with the smallest share of unshared shingles; lists are salted, so leaders are many where lists are long). The
   links found are contracted to components.
4. Second round: the lists that still hold two components are compared in blocks of bounded size: group pairs are
   filtered by size, expanded to members of different components, and filtered by an upper bound of the
   overlap (counts of 128 hash ranges). What is left is verified. Together with the first round, every
   pair of classes that can reach the threshold is either verified or already connected.

join_pairs() runs the second round with every class a component of its own: it returns all links between
classes. components() is what near-duplicate removal needs.

Hashes of shingles have 64 bits and are compared within a pair of texts; set keys have 128.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing, not
even its like; fewer words than a shingle give one shingle, the whole sequence; rows that repeat an id are
judged by their texts; a null id is never the smallest of a component that has another; an empty table
gives an empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, sketch
from . import kernels as K
from .staging import cut, fresh, staged, text_bytes

SIZE = 5
SALTS = 8
BLOCK = 512
RANGES = 128
#: Bytes a word and its space are expected to take: one shingle begins at each word.
WORD_BYTES = 5
#: Prefixes of up to so many shingles travel along, so that a pair is compared under its first common one only.
SHORT = 64
MADE = ("n_shingles", "component_id")


def shingle_sets(texts, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = K.lay_out(texts, lower=True)
    starts, ends, first = K.words_of(data, at)
    h = K.word_hashes(data, starts, ends)
    w = K.window_hashes(h, size, K.BASE_A)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        if n >= size:
            out.append(np.unique(w[lo : hi - size + 1]))
        elif n:
            out.append(K.mix(K.window_hashes(h[lo:hi], n, K.BASE_A) + K.U64(n)))
        else:
            out.append(w[:0])
    return out


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (a + b)


_SETS = pa.schema([("n", pa.int64()), ("key", pa.binary()), ("shared", pa.int64()), ("own", pa.list_(pa.int64())), ("prefix", pa.int32()), ("family", pa.binary())])
_SETS_DDL = [T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("shared", T.LongType()), T.StructField("own", T.ArrayType(T.LongType())), T.StructField("prefix", T.IntegerType()), T.StructField("family", T.BinaryType())]


def mark_of(text: Column) -> Column:
    """128 bits that tell rows of one id with different texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sets_of(docs: DataFrame, id_column: str, text: str, size: int, percent: int, marked: bool = False) -> DataFrame:
    """One row a text: id, n, key and, for the first of a class in its bucket if the class may join, the shared
    shingles in order, how many of them the prefix holds, and the group of that prefix and size; the mark of
    the text, if asked for."""
    own = docs.select(id_column, text, *([mark_of(F.col(text)).alias("__mark")] if marked else []))
    grid = sketch.grid(docs.sparkSession, text_bytes(own, text), WORD_BYTES)
    dealt = sketch.dealt(own, id_column, text, grid)

    def found_in(table: pa.Table):
        made = [(piece, shingle_sets(piece.column(1), size)) for piece in cut(table.to_batches(), text)]
        return made, np.concatenate([np.zeros(0, K.U64), *(s for _, sets in made for s in sets)])

    def send(table: pa.Table) -> pa.Table:
        return sketch.packets(table.column("__bucket")[0].as_py(), np.unique(found_in(table)[1]), grid)

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        made, shingles = found_in(table)
        keys, place, here = sketch.distinct(shingles)
        # a shingle of two texts of this bucket and of no other: 1 in all texts that hold it
        often = np.maximum(sketch.orders_told(answers, keys, grid), here)[place] if len(keys) else np.zeros(0, np.uint8)
        told: set[bytes] = set()
        at, out = 0, []
        for piece, sets in made:
            rows = {f.name: [] for f in _SETS}
            for s in sets:
                order = often[at : at + len(s)]
                at += len(s)
                shared = s[order > 0]
                shared = shared[np.argsort(order[order > 0], kind="stable")]
                n, key = len(s), set_key(s) if len(s) else None
                left = prefix_size(n, percent) - (n - len(shared))
                if n and left > 0 and key not in told:
                    told.add(key)
                    group = hashlib.blake2b(shared[:left].tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest()
                    row = (n, key, len(shared), shared.view(np.int64), min(left, len(shared)), group)
                else:
                    row = (n, key, None, None, None, None)
                for name, v in zip(rows, row):
                    rows[name].append(v)
            out.append(pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(rows[f.name], f.type) for f in _SETS), *piece.columns[2:-1]], names=[id_column, *_SETS.names, *piece.schema.names[2:-1]]))
        return pa.Table.from_batches(out)

    sent = dealt.groupBy("__bucket").applyInArrow(send, sketch.PACKET_DDL)
    answers = sketch.by_shard(sent, grid).applyInArrow(sketch.merger(grid, counts=True), sketch.ANSWER_DDL)
    made = dealt.groupBy("__bucket").cogroup(answers.groupBy("bucket")).applyInArrow(judge, T.StructType([own.schema[id_column], *_SETS_DDL, *own.schema.fields[2:]]))
    return staged(made, "sets")


def first_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of the first round that sizes allow: classes and their leaders, within groups and within posting
    lists. Rank: share of unshared shingles, then a hash. Lists are salted and their leaders meet once more."""
    kept = ("id", "n", "shared", "rank")

    def stars(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
        """Pairs of a class and its leader within each group, and the leader's row of each group."""
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))

        def led(df: DataFrame, *by: str) -> DataFrame:
            return df.withColumn("b", F.min_by(F.struct("id", "n", "shared"), "rank").over(Window.partitionBy(*by)))

        near = led(salted, group, "__salt")
        far = led(near.where(F.col("id") == F.col("b.id")).drop("b", "__salt"), group)
        pairs = near.select("id", "n", "shared", "b").unionByName(far.select("id", "n", "shared", "b"))
        able = pairs.where((F.col("id") != F.col("b.id")) & linked(F.least("shared", "b.shared"), F.col("n"), F.col("b.n"), percent))
        return able.select(F.least("id", "b.id").alias("a"), F.greatest("id", "b.id").alias("b")), far.where(F.col("id") == F.col("b.id")).drop("b")

    rank = F.round(F.lit(1.0) - F.col("shared") / F.col("n"), 3) + F.pmod(F.xxhash64("id"), F.lit(2**40)) / F.lit(2.0**52)
    in_groups, heads = stars(classes.select("family", "id", "n", "shared", rank.alias("rank")), "family")
    posted = heads.select(*kept).join(classes.select("id", "top"), "id").select(*kept, F.explode("top").alias("token"))
    in_lists, _ = stars(posted, "token")
    return in_groups.unionByName(in_lists).distinct()


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, n_a, n_b, overlap of the pairs that reach the threshold. A class with many partners, as a leader
    has, is dealt by a hash of the partner: its shingles go to each (class, salt) that is wanted once. The pairs are
    written first, as they are read more than once."""

    salt = lambda other: F.pmod(F.xxhash64(other), F.lit(graph.SALTS))
    own = staged(pairs.select("a", "b", salt("b").alias("salt_a"), salt("a").alias("salt_b")), "pairs")

    def side(c: str) -> DataFrame:
        there = classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}"))
        return own.select(c, f"salt_{c}").distinct().join(there, c)

    met = own.join(side("a"), ["a", "salt_a"]).join(side("b"), ["b", "salt_b"])
    overlap = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("own_a", "own_b")).cast("long").alias("overlap"))
    return overlap.where(linked(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent))


def block_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with different labels that share a prefix shingle and may reach the threshold."""
    posted = classes.select("id", "label", F.explode("top").alias("token"))
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    live = posted.select("token", "id").join(lists, "token")
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    dealt = live.withColumn("own", own).withColumn("pair", F.explode(others)).select("token", "id", "own", "pair.i", "pair.j")
    infos = classes.select("id", "label", "n", "shared", "family", "counts", F.when(F.size("top") <= SHORT, F.col("top")).otherwise(F.array().cast("array<bigint>")).alias("top"))
    rows = dealt.join(infos, "id").select("token", "i", "j", "own", "id", "label", "n", "shared", "family", "counts", "top")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        token, i, j = (table.column(c)[0].as_py() for c in ("token", "i", "j"))
        ids, label, n, shared, own = (table.column(c).to_numpy() for c in ("id", "label", "n", "shared", "own"))
        group = np.unique(table.column("family").to_numpy(), return_inverse=True)[1]
        packed = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("counts")])
        # counts are in units that the first four bytes tell, rounded up
        counts = packed[:, 4:].astype(np.int32) * packed[:, :4].copy().view("<i4")
        tops = [x.values.to_numpy() for x in table.column("top")]
        earlier = np.full((len(ids), SHORT), token, np.int64)
        for k, top in enumerate(tops):
            top = top[top < token]
            earlier[k, : len(top)] = top
        least = np.unique(group, return_index=True)[1]
        most = np.zeros(len(least), np.int64)
        np.maximum.at(most, group, shared)
        size = n[least]
        # group pairs by size: what the shared shingles of either allow
        able = (100 + percent) * np.minimum(most[:, None], most[None, :]) >= percent * (size[:, None] + size[None, :])
        left, right = [], []
        for a in np.flatnonzero(own == i):
            mask = able[group[a], group] & (own == j) & (label != label[a])
            if i == j:
                mask[: a + 1] = False
            b = np.flatnonzero(mask)
            b = b[(100 + percent) * np.minimum(shared[a], shared[b]) >= percent * (n[a] + n[b])]
            if not len(b):
                continue
            bound = np.minimum(counts[b], counts[a]).sum(axis=1, dtype=np.int64)
            b = b[(100 + percent) * bound >= percent * (n[a] + n[b])]
            before = earlier[a][earlier[a] < token]
            if len(before) and len(b):
                b = b[~np.isin(earlier[b], before).any(axis=1)]
            left += [ids[a]] * len(b)
            right += ids[b].tolist()
        x, y = np.array(left, np.int64), np.array(right, np.int64)
        return pa.Table.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)}, schema=schema)

    return rows.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _counts(batches):
    for batch in batches:
        found = []
        for x in batch.column(batch.schema.get_field_index("own")):
            own = np.bincount((x.values.to_numpy().view(K.U64) >> K.U64(57)).astype(np.int64), minlength=RANGES)
            unit = max(1, -(-int(own.max()) // 255))
            found.append(np.array([unit], "<i4").tobytes() + (-(-own // unit)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "counts"])


def classes_of(sets: DataFrame) -> DataFrame:
    """One row a class that may join: id (any number), key, n, shared, own, family, top (prefix shingles),
    counts. Written once, which fixes the ids."""
    found = sets.where("own is not null").dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("id"), "key", "n", "shared", "own", F.xxhash64("family").alias("family"), F.slice("own", 1, F.col("prefix")).alias("top"))
    return staged(found.mapInArrow(_counts, T.StructType([*found.schema.fields, T.StructField("counts", T.BinaryType())])), "classes")


def join_pairs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """All links between classes (a, b, n_a, n_b, overlap; a and b are class ids) and the membership (id column,
    n, class; null for a class that no other can join). Texts of one class are linked with each other too."""
    sets = sets_of(fresh(docs, *MADE), id_column, text, size, percent)
    classes = classes_of(sets)
    members = sets.select(id_column, "n", "key").join(classes.select("key", F.col("id").alias("class")), "key", "left")
    return verified(block_pairs(classes.withColumn("label", F.col("id")), percent), classes, percent), members


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = 75) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    return _judged(sets_of(fresh(docs, *MADE), id_column, text, size, percent), id_column, percent).select(id_column, *MADE)


def _judged(sets: DataFrame, id_column: str, percent: int) -> DataFrame:
    """The rows of sets with what components() tells of them, and what tells components of one smallest id
    apart: label or, for a class that is linked with no other, key. Both are null for a text without words."""
    classes = classes_of(sets)
    first = staged(verified(first_pairs(classes, percent), classes, percent).select("a", "b"), "links")
    labels = graph.components(first)
    labelled = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    second = verified(block_pairs(labelled, percent), classes, percent).select("a", "b")
    labels = graph.components(first.unionByName(second))

    more = [c for c in sets.columns if c == "__mark"]
    texts = sets.select(id_column, F.col("n").alias("n_shingles"), "key", *more)
    salted = texts.where("n_shingles > 0").withColumn("__salt", F.pmod(F.xxhash64(id_column), F.lit(graph.SALTS)))
    parts = salted.groupBy("key", "__salt").agg(F.min(id_column).alias("part"))
    roots = parts.groupBy("key").agg(F.min("part").alias("root"))
    keyed = labels.withColumnRenamed("node", "id").join(classes.select("id", "key"), "id").join(roots, "key")
    joined = graph.with_least(keyed, "label", "root", "least", "id").select("key", "least", "label")
    tops = roots.join(joined, "key", "left").select("key", F.coalesce("least", "root").alias("component_id"), "label")
    down = salted.join(parts.select("key", "__salt").join(tops, "key"), ["key", "__salt"]).select(id_column, *MADE, "label", "key", *more)
    return down.unionByName(texts.where("n_shingles = 0").select(id_column, "n_shingles", F.col(id_column).alias("component_id"), "key", *more), allowMissingColumns=True)


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = 75) -> DataFrame:
    """One row of docs for each component, of the smallest id (a null one if the component has no other; of several
    texts under that id, the one with the smallest mark), and every row without words, which nothing is linked
    with. Texts meet the ids and marks that stay in a shuffled join at every size."""
    rows = _judged(sets_of(fresh(docs, *MADE), id_column, text, size, percent, marked=True), id_column, percent)
    firsts = rows.where((F.col("n_shingles") > 0) & F.col(id_column).eqNullSafe(F.col("component_id")))
    ones = firsts.groupBy("label", F.when(F.col("label").isNull(), F.col("key")).alias("alone")).agg(F.min(id_column).alias("__id"), F.min("__mark").alias("__of"), F.count(F.lit(1)).alias("count"))
    empty = rows.where("n_shingles = 0").select(F.col(id_column).alias("__id"), F.col("__mark").alias("__of"), F.lit(0).cast("long").alias("count")).distinct()
    kept = staged(ones.select("__id", "__of", "count").unionByName(empty), "kept")
    marked = docs.withColumn("__mark", mark_of(F.col(text)))

    def met(some: DataFrame) -> DataFrame:
        # the ids that stay are as many as documents: they are never broadcast, at any size
        return marked.join(some.hint("shuffle_hash"), F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of")), "left_semi")

    if not kept.where("count > 1").limit(1).count():
        return met(kept).drop("__mark")
    return met(kept.where("count < 2")).unionByName(met(kept.where("count > 1")).dropDuplicates([id_column, "__mark"])).drop("__mark")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return components(docs.select("doc_id", "text"))

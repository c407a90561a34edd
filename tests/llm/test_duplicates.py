"""Operators 3, 6 and 8 against brute force on small fixtures with every odd row."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import jaccard_join, kernels, sketch, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def brute_windows(rows, size):
    least = {}
    words = [WORD.findall(r[1] or "") for r in rows]
    ids = [LAST if r[0] is None else r[0] for r in rows]
    for i, w in zip(ids, words):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, LAST), i)
    out = []
    for r, i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def test_word_windows(docs, rows):
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_windows(rows, 13)
    for r in got:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed
    assert {r.lang for r in got} == {"en", None}


def test_cut_texts_keep_their_layout(docs, rows):
    got = substring_dedup.remove_repeats(docs, layout=True).collect()
    for r in got:
        t = r.text or ""
        at = [m.start() for m in WORD.finditer(t)] + [len(t)]
        gone = [range(at[s.first], at[s.end]) for s in r.removed]
        assert r.cut_text == "".join(c for k, c in enumerate(t) if not any(k in g for g in gone))
        assert WORD.findall(r.cut_text) == r.kept_text.split(" ") * (r.kept_text != "")


def test_word_windows_digest_and_empty(docs, rows, no_docs):
    want = Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for (i, n, m, t), k in brute_windows(rows, 13).items() for _ in range(k))
    assert Counter(map(tuple, substring_dedup.digest(docs).collect())) == want
    assert substring_dedup.digest(no_docs).count() == 0


def brute_bytes(rows, size):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((r[0], len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


def test_byte_strings(docs, rows, no_docs):
    assert Counter(map(tuple, suffix_dedup.digest(docs).collect())) == brute_bytes(rows, 200)
    assert suffix_dedup.digest(no_docs).count() == 0
    with_spans = suffix_dedup.remove_repeats(docs).collect()
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in with_spans)


@pytest.mark.parametrize("text", ["ab" * 700, "a" * 401, "".join(chr(97 + k * k % 26) for k in range(1500)), "é日" * 200, "".join(map(str, range(600))) * 2])
def test_byte_strings_of_periodic_texts(spark, text):
    rows = [(1, text), (2, text[:250] + "|" + text[300:700]), (3, "z" + text[100:420]), (4, None), (5, text[-260:] + text[:260])]
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 200)


def brute_components(rows, size=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = WORD.findall((t or "").translate(fold))
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                label[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = find(i)
            least[k] = r[0] if least[k] is None else min(least[k], r[0])
    return Counter((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_components(docs, rows, no_docs):
    assert Counter(map(tuple, jaccard_join.components(docs).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)
    assert jaccard_join.components(no_docs).count() == 0


def near_family(n=40, words=90):
    base = [f"w{k}" for k in range(words)]
    rows = [(100, " ".join(base))]
    for k in range(1, n):
        own = list(base)
        for e in range(1 + k % 4):
            own[(7 * k + 19 * e) % words] = f"e{k}x{e}"
        rows.append((100 + k, " ".join(own)))
    return rows


def test_components_of_a_family_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # many blocks
    rows = near_family()
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_join_pairs_returns_every_link(spark):
    rows = near_family(24)
    links, members = jaccard_join.join_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r["class"]: r.doc_id for r in members.collect()}
    got = {frozenset((of[r.a], of[r.b])) for r in links.collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(86)) for i, t in rows}
    want = {frozenset((i, j)) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert got == want


def test_keep_first_leaves_one_of_each_component(docs, rows):
    kept = Counter(r.doc_id for r in jaccard_join.keep_first(docs).collect())
    want = {i for (i, _, c) in brute_components(rows) if i is not None and i == c}
    assert {i for i in kept if i is not None} == want
    assert all(n == 1 for i, n in kept.items())


def test_keep_first_decides_by_row(spark):
    unique = lambda k: " ".join(f"u{k}x{j}" for j in range(60))
    near = lambda k: unique(k).replace(f"u{k}x7 ", "edit ")
    rows = [(None, unique(0)), (None, unique(1)), (None, near(1)), (None, unique(2)), (2, near(2)), (3, unique(3)), (3, unique(4)), (3, unique(4))]
    rows += [(4, unique(5)), (4, near(5)), (5, near(3)), (5, unique(6)), (6, ""), (6, None), (6, unique(7)), (None, None), (None, " ")]
    got = Counter((r.doc_id, r.text) for r in jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    of = lambda *texts: sum(got[i, t] for i in (None, 2, 3, 4, 5, 6) for t in texts)
    assert got[None, unique(0)] == got[2, near(2)] == got[3, unique(3)] == got[3, unique(4)] == got[5, unique(6)] == got[6, unique(7)] == 1
    assert of(unique(1), near(1)) == of(unique(5), near(5)) == of(unique(2), near(2)) == of(unique(3), near(3)) == 1
    assert got[6, ""] == got[6, None] == got[None, None] == got[None, " "] == 1 and sum(got.values()) == 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.integers(0, 3))
def test_gap_code_round_trip(values, low):
    values = np.sort(np.array(values, np.int64)) % (1 << (12 + 8 * low))
    values.sort()
    gaps, planes = sketch._gaps(values, low)
    assert sketch._values(gaps, np.frombuffer(planes, np.uint8).reshape(low, len(values)), low).tolist() == values.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\t\n ", max_size=40)), max_size=8))
def test_words_of_any_texts(texts):
    data, at = kernels.lay_out(texts)
    starts, ends, first = kernels.words_of(data, at)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[lo:hi], ends[lo:hi])] for lo, hi in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


def through_the_sketch(buckets, grid, counts=False):
    """What each bucket is told of its keys, without Spark."""
    sent = pa.concat_tables([sketch.packets(k, keys, grid) for k, keys in enumerate(buckets)])
    merge = sketch.merger(grid, counts)
    told = pa.concat_tables([merge(sent.filter(pc.equal(sent.column("shard"), s))) for s in pc.unique(sent.column("shard")).to_pylist()])
    own = [told.filter(pc.equal(told.column("bucket"), k)) for k in range(len(buckets))]
    return [sketch.orders_told(t, keys, grid) if counts else sketch.bits_told(t, sketch.SKETCH, keys, grid) for t, keys in zip(own, buckets)]


@pytest.mark.parametrize("n_buckets", [1, 5, 64])
def test_sketch_misses_no_repeated_key_and_passes_few_single_ones_at_any_size(n_buckets):
    """Cells follow the keys: the share of single keys that pass is the same however many buckets there are."""
    r = np.random.default_rng(3)
    common = kernels.mix(r.integers(0, 2**63, 50, np.uint64))
    buckets = [np.unique(np.concatenate([kernels.mix(r.integers(0, 2**63, 4000, np.uint64)), common])) for _ in range(n_buckets)]
    n = sum(map(len, buckets))
    grid = sketch.sized(5 * n, 5, n_buckets)._replace(buckets=n_buckets)
    assert 4 <= (grid.shards << grid.cell_bits) / n <= 17
    told = through_the_sketch(buckets, grid)
    for keys, seen in zip(buckets, told):
        shared = np.isin(keys, common)
        assert seen[shared].all() == (n_buckets > 1) and seen[~shared].mean() < 0.1


def test_sketch_has_no_largest_size():
    """30 GB, 1 TB and 100 TB: four cells a key, packets of about equal size, small ranges."""
    for size in (30 * 10**9, 10**12, 10**14):
        grid = sketch.sized(size, 5, 200)
        cells = grid.shards << grid.cell_bits
        assert cells >= 4 * size / 5 and grid.shard_bits + grid.cell_bits <= 56
        assert size / 5 / grid.buckets / grid.shards > 400


def test_sketch_orders_keys_by_frequency():
    r = np.random.default_rng(4)
    common, rare = kernels.mix(r.integers(0, 2**63, 20, np.uint64)), kernels.mix(r.integers(0, 2**63, 20, np.uint64))
    buckets = [np.unique(np.concatenate([kernels.mix(r.integers(0, 2**63, 2000, np.uint64)), common, rare if k < 2 else rare[:0]])) for k in range(32)]
    grid = sketch.sized(5 * 32 * 2040, 5, 32)._replace(buckets=32)
    told = through_the_sketch(buckets, grid, counts=True)
    of = lambda keys: [told[k][np.isin(buckets[k], keys)] for k in range(2)]
    assert all((x >= 5).all() for x in of(common)) and all((x == of(rare)[0]).all() for x in of(rare)) and np.median(of(rare)[0]) == 1
    assert np.mean(told[0][~np.isin(buckets[0], [*common, *rare])] == 0) > 0.9

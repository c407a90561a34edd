"""Operators 1, 2, 4, 5, 7, 9 and 10 against brute force, round trips and odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, html_extract, packing, quality, tokens, training_order, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 5: quality rules


def brute_metrics(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = [False] * len(w)
    for k in range(len(w) - 4):
        if windows[tuple(w[k : k + 5])] > 1:
            hit[k : k + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit)


def test_quality_metrics(docs, rows, no_docs):
    got = Counter(map(tuple, quality.digest(docs).select("doc_id", *quality.MADE, "base_failed").collect()))
    want = Counter()
    for r in rows:
        m = brute_metrics(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    assert quality.digest(no_docs).count() == 0


def test_quality_order_decides_no_verdict(docs):
    own, text, words = quality.with_words(docs, "text")
    rejects = quality.bound(quality.RULES, quality.lazy(text, words))
    kept = [own.where(quality.verdict(order, rejects).isNull()).count() for order in (list(rejects), list(rejects)[::-1])]
    assert kept[0] == kept[1] > 0


def test_quality_order_is_by_rejections_per_cost_and_stable(docs):
    found = quality.ordered(docs)
    assert {n for n, _, _ in found} == set(quality.RULES)
    assert [-s / c for _, s, c in found] == sorted(-s / c for _, s, c in found)
    assert found == quality.ordered(docs) == quality.ordered(docs.repartition(2))


def test_quality_metrics_in_the_chain_are_those_of_the_report(docs):
    chain = quality.judged(docs).select("doc_id", "text", "rejected_by")
    report = quality.judged(docs, metrics=True).select("doc_id", "text", "rejected_by")
    assert Counter(map(tuple, chain.collect())) == Counter(map(tuple, report.collect()))
    own, text, words = quality.with_words(docs, "text")
    every = quality.lazy(text, words) | {"n_repeat_words": quality.repeat_words(words, F.lit(0))}
    got = own.select("text", *(every[m].alias(m) for m in quality.MADE)).collect()
    assert all(tuple(r)[1:] == brute_metrics(r.text) for r in got)


def test_quality_short_circuits(spark):
    """A metric that raises is never reached for a text that an earlier rule rejects."""
    docs = spark.createDataFrame([(1, "too few")], "doc_id long, text string")
    rules = {"few": quality.RULES["few_words"], "raises": (("n_words",), lambda n: F.raise_error(F.lit("reached")).cast("boolean"))}
    own, text, words = quality.with_words(docs, "text")
    assert own.select(quality.verdict(["few", "raises"], quality.bound(rules, quality.lazy(text, words)))).first()[0] == "few"


def test_quality_of_a_very_long_text(spark):
    text = " ".join(f"w{k * k % 90_001}" for k in range(250_000))
    got = quality.measured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got)[2:] == brute_metrics(text)


def test_quality_stays_native(docs):
    for metrics in (False, True):
        plan = quality.judged(docs, metrics=metrics)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# 7: chat formatting

TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "\\", "<", "|", "", None, "\n<|next|>\\\\|", "日本 <|turn|>user<|text|>"]
    rows = [(c, k, ["user", "assistant", "assistant", None, "sys<|tem"][(k + c) % 5], t, "x") for c in range(4) for k, t in enumerate(nasty)]
    rows += [rows[0], (None, 0, "user", "no id", None), (9, None, "assistant", "null turn", None)]
    made = chat_format.format_turns(spark.createDataFrame(rows, TURNS)).select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.learned_text(F.col("segments")).alias("learned"))
    by = {}
    for c, k, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    for r in made.collect():
        own = sorted(by.pop(r.conv_id))
        assert [(t.role, t.text) for t in r.back] == [t[1:] for t in own]
        assert r.learned == "".join(t for _, role, t in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    assert not by


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|\\>nadetx end[]", max_size=30), min_size=1, max_size=6))
def test_chat_round_trip_of_any_text(spark, texts):
    rows = [(1, k, f"r{k % 2}", t, None) for k, t in enumerate(texts)]
    made = chat_format.format_turns(spark.createDataFrame(rows, TURNS)).select(chat_format.read_back(F.col("formatted")).alias("back")).first()
    assert [t.text for t in made.back] == texts


def test_chat_empty_and_probe(spark):
    got = chat_format.digest(spark.createDataFrame([], TURNS)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-1, 2, 21)]
    assert got[0].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


# 10: decontamination

ITEMS = [(1, "One two three four five six seven eight nine"), (10, "short ITEM"), (2, None), (3, " .,"), (None, "a b"), (1, "alpha beta"), (4, "one two three four five six seven eight")]
TEXTS = [(1, "x one, two THREE four five six seven EIGHT nine."), (2, "a short-item, shorter item"), (3, None), (4, ""), (5, "alpha; beta one two three four five six seven eight one two"), (1, "short item short item é"), (6, "café short item"), (None, "alpha beta")]


def brute_items(text, items, size=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w = words(text)
    hit, found = [False] * len(w), set()
    for name, body in items:
        own = words(body)
        for k in range(max(1, len(own) - size + 1) if own else 0):
            v = own[k : k + size]
            for j in range(len(w) - len(v) + 1):
                if w[j : j + len(v)] == v:
                    found |= {str(name)} if name is not None else set()
                    hit[j : j + len(v)] = [True] * len(v)
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_items(spark, block_bytes):
    docs = spark.createDataFrame([(*t, "clash") for t in TEXTS], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.find_items(docs, bench, block_bytes=block_bytes)
    for r in got.collect():
        want = brute_items(r.text, ITEMS)
        assert (r.n_words, r.n_hit, len(r["items"])) == want[:3]
        assert all(r.text[s.begin : s.end].lower().split()[0].strip(".,;") for s in r.spans)
    if block_bytes > 100:
        assert Counter(map(tuple, decontamination.digest(docs, bench).collect())) == Counter((i, *brute_items(t, ITEMS)) for i, t in TEXTS)


def test_items_of_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontamination.digest(docs, none).collect()} == {False}
    assert decontamination.digest(docs.where("false"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# 9 and 2: packing and training order


def test_both_libraries_give_the_same_ids(rows):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    encode = tokens.encoder()
    texts = [r[1] for r in rows if r[1]] + ["naïve  café\r\n\t½ ¿x?", "  two  spaces \n\n", "<|endoftext|>", "\u0085\u00a0\u2003", "'s 'T we'll", "日本 123½"]
    for t in texts:
        assert encode(t) == exact.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=40))
def test_fast_library_on_common_characters(text):
    global _both
    try:
        fast, exact = _both
    except NameError:
        import base64

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        exact.encode_special_tokens = True
        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _both = fast, exact
    if tokens.COMMON.match(text):
        assert fast.encode_ordinary(text) == exact.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, no_docs):
    got = packing.pack(docs, length=64).toPandas()
    encode = tokens.encoder()
    want = Counter()
    for r in rows:
        ids = np.array([*encode(r[1] or ""), 2], "<u4")
        begins = tokens.cuts(len(ids), 64)
        for k, (lo, hi) in enumerate(zip(begins, [*begins[1:], len(ids)])):
            want[(-1 if r[0] is None else r[0], k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))] += 1
            assert hi - lo == 64 or k == 0
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 64
    bins = []  # first fit, longest first
    for n in sorted(got.length, reverse=True):
        k = next((k for k, free in enumerate(bins) if free >= n), None)
        if k is None:
            bins.append(64 - n)
        else:
            bins[k] -= n
    assert got.sequence_id.nunique() <= len(bins)
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=12))
def test_plan_places_every_rank_once(histogram):
    counts = np.zeros(51, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    plan = packing.plan(counts, 50)
    load = Counter()
    for length in histogram:
        own = np.flatnonzero(plan["length"] == length)
        spans = sorted((plan["first"][k], plan["first"][k] + plan["size"][k]) for k in own)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == counts[length]
        for k in own:
            for s in range(plan["size"][k] // plan["each"][k]):
                load[plan["sequence"][k] + s] += length * plan["each"][k]
    assert all(v <= 50 for v in load.values()) and sum(load.values()) == (counts * np.arange(51)).sum()


def test_the_plan_is_the_fitted_one_and_no_longer_than_filling_longest_first():
    r = np.random.default_rng(9)
    for pieces in (np.clip(r.lognormal(4.5, 1.0, 1500), 2, 1024), r.integers(2, 1025, 4000), np.concatenate([np.full(900, 1024), r.integers(2, 700, 600)])):
        counts = np.bincount(pieces.astype(int), minlength=1025)
        plan = packing.plan(counts, 1024)
        rows = packing.patterns(np.flatnonzero(counts[:1024]), 1024)
        greedy = packing._rounded(counts, 1024, rows, np.zeros(len(rows), np.int64))[1]
        assert plan["fitted"].any() and max(plan["sequence"] + plan["size"] // plan["each"]) <= greedy


def test_a_vocabulary_beyond_16_bits_is_refused(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "encoder", lambda _: lambda text: [70_000])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x"]})
    assert next(tokens.pieces()(iter([batch]))).num_rows == 1
    with pytest.raises(ValueError):
        next(tokens.pieces(ids=True)(iter([batch])))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**70))
def test_feistel_is_a_permutation(n, key):
    got = training_order.feistel(np.arange(n), n, key)
    assert sorted(got.tolist()) == list(range(n))


def brute_slots(rows, length, key):
    """(doc_id, piece, crc) by slot: sequences sorted by id, hash of the text and place, then permuted."""
    import xxhash

    encode = tokens.encoder()
    mark = lambda t: int(np.array([xxhash.xxh64_intdigest((t or "").encode(), 42)], np.uint64).view(np.int64)[0])
    made = []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]))):
        ids = np.array([*encode(text or ""), 2], "<u4")
        begins = tokens.cuts(len(ids), length)
        made += [(doc, k, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(begins, [*begins[1:], len(ids)]))]
    slots = training_order.feistel(np.arange(len(made)), len(made), key)
    return dict(zip(slots.tolist(), made))


def test_training_order_against_brute_force(docs, rows, no_docs, spark, tmp_path):
    path = str(tmp_path / "shards")
    made = training_order.shards(docs, per_shard=16, length=64, path=path)
    found = lambda df: {r.slot: (r.doc_id, r.piece, r.ids_crc32) for r in df.collect()}
    got = training_order.contents(made, 16, 64)
    want = brute_slots(rows, 64, training_order.KEY)
    assert found(got) == want and got.count() == len(want)
    assert got.where("shard != slot div 16 or byte_offset != slot % 16 * " + str(training_order.stride(64))).count() == 0
    for r in made.collect():
        assert len(r.payload) == r.n_slots * training_order.stride(64) and r.first_slot == r.shard * 16
        doc, piece, ids = training_order.read_slot(r.payload, r.first_slot, 16, 64)
        assert (doc, piece, zlib.crc32(ids.astype("<u4").tobytes())) == want[r.first_slot]
    # a run that stopped goes on from any slot of the written files
    for first in (1, 37, len(want) - 1, len(want)):
        assert found(training_order.resumed(spark, path, first, 16, 64)) == {s: v for s, v in want.items() if s >= first}
    # another partitioning, and more ranges than travel in a closure, give the same order
    again = training_order.shards(docs.repartition(7, "text"), per_shard=16, length=64, few_ranges=1)
    assert found(training_order.contents(again, 16, 64)) == want
    other = training_order.contents(training_order.shards(docs, key=5, per_shard=16, length=64), 16, 64)
    assert found(other) == brute_slots(rows, 64, 5)
    assert training_order.contents(training_order.shards(no_docs)).count() == 0


def test_training_order_of_a_long_text(spark):
    rows = [(k, t) for k, t in [(1, "word 日本 " * 60_000), (None, None), (2, ""), (None, None)]]
    made = training_order.contents(training_order.shards(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r.slot: (r.doc_id, r.piece, r.ids_crc32) for r in made.collect()} == brute_slots(rows, tokens.LENGTH, training_order.KEY)


# 4: URL filter


def test_urls(spark):
    urls = [None, "nope", "HTTP://A.Example.ORG/es/x?y#z", "http://x.example.org/en/1?y", "http://b.com/fr/", "a://x.com/de/1", "http://org/", "http://xorg/", "http://q.net", "s://example.org/en/12", "http://com/de/?://org/", "://org/x"]
    upper = str.maketrans(url_filter.UPPER, url_filter.LOWER)

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(upper)
        fits = [r for r, _ in url_filter.STATED if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits, key=len, default=None)

    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls * 2)], "page_id long, url string, host string")
    for r in url_filter.filter_urls(pages, []).collect():
        assert (r.host, r.path, r.rule) == brute(r.url)
        assert r.verdict == dict(url_filter.STATED).get(r.rule, "allow")
    assert url_filter.filter_urls(pages.where("false"), []).count() == 0


def test_mined_rules(spark):
    rows = [(f"http://spam.bad.io/x{k}/a?id={k}", True) for k in range(40)] + [(f"https://good.io/x{k}/a", False) for k in range(60)] + [("http://spam.bad.io/y", None), (None, True)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filter.mine(labelled)
    assert rules and all(c >= url_filter.MIN_CONFIDENCE for _, c in rules)
    held = {o for o, _ in rules}
    assert not any(a < b for a in held for b in held)  # nothing redundant is left at confidence 1
    got = {r.url: r.verdict for r in url_filter.filter_urls(labelled.select("url"), rules, stated=()).collect()}
    assert all(got[u] == ("block" if bad else "allow") for u, bad in rows if u and bad is not None)
    assert url_filter.mine(labelled.where("false")) == []


def test_every_part_of_a_url_is_mined(spark):
    url = "http://m.Casino-Win.example.com/a/b7/c/x.html?ref=1&page=2#top"
    held = spark.createDataFrame([(url,)], "url string").select(url_filter.tokens(F.col("url"))).first()[0]
    assert {"label=m", "label=casino-win", "word=casino", "word=win", "folder=a", "folder=bN", "folder=c", "folder=x.html", "query=ref", "query=page"} <= set(held)
    labelled = [(f"http://m.cheap-pills.example.com/en/{k}", True) for k in range(6)] + [(f"http://m.site{k % 9}.example.com/en/{k}", False) for k in range(2000)]
    rules = url_filter.mine(spark.createDataFrame(labelled, "url string, bad boolean"))
    asked = spark.createDataFrame([("http://www.pills-now.example.net/fr/1/",), ("http://m.site1.example.com/en/7",)], "url string")
    assert {r.url[7:10]: r.verdict for r in url_filter.filter_urls(asked, rules, stated=()).collect()} == {"www": "block", "m.s": "allow"}


def test_patterns_are_all_and_bounded(spark):
    baskets = [(["a", "b", "c", "d"], 3, 2), (["b", "c", "d", "e"], 4, 1), (["a", "c", "e"], 5, 3), (["d"], 9, 9), (["f"], 1, 1), ([f"t{k}" for k in range(40)], 3, 3)]
    got = {tuple(r.own): (r.n, r.bad) for r in url_filter.patterns(spark.createDataFrame(baskets, "items array<string>, n long, bad long"), 2, 3).collect()}
    sums = {}
    for items, n, bad in baskets:
        for own in (o for size in (1, 2, 3) for o in itertools.combinations(sorted(items), size)):
            sums[own] = tuple(map(sum, zip(sums.get(own, (0, 0)), (n, bad))))
    assert got == {own: v for own, v in sums.items() if v[1] >= 2}


def test_labels_meet_numbers_before_a_slash(spark):
    urls = ["http://x.org/en/1291/", "http://x.org/en/1291.html", "http://x.org/en/1291?page=2", "http://x.org/1291/en"]
    labels = spark.createDataFrame([(1291, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.url for r in url_filter.labelled_pages(spark.createDataFrame([(u,) for u in urls], "url string"), labels).collect()} == set(urls[:3])


# 1: HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="wrap"><div class="cookie-notice">We use cookies</div><div class="content post%d"><h2>Head&nbsp;line &amp; more</h2>
<p>First <b>bold</b>
 text, long enough to be <a href="x">prose</a>.<script>var t="<p>no</p>"</script><p>Second &lt;b&gt; paragraph<!-- <p>no</p> --> of the article.</p><ul><li>one<li>two</ul><form>Name <input></form></div>
<aside>Related</aside><div id="comments"><p>First!!</p></div></div><footer>&copy; x</footer>"""
TEXT = "Head line & more\nFirst bold text, long enough to be prose.\nSecond <b> paragraph of the article.\none\ntwo"


@pytest.mark.parametrize("hosts", [1000, 0])
def test_pages(spark, hosts):
    pages = [(k, f"http://Site.example/{k}", PAGE % k, "clash") for k in range(6)]
    pages += [(10, None, None, None), (11, "u", "", None), (12, "http://site.example/x", "<p>plain <b>text", None), pages[0], (13, "http://other.example/", "<article><header><h1>T</h1></header><section>a</section><section>b</section></article>", None)]
    got = html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, text string"), broadcast_hosts=hosts).collect()
    assert len(got) == len(pages)
    for r in got:
        want = TEXT if r.page_id < 10 else {10: "", 11: "", 12: "plain text", 13: "T\na\nb"}[r.page_id]
        assert r.text == want and r.n_chars == len(want)
    assert {r.path for r in got if r.page_id < 6} == {"html>body>div.wrap>div.content.postN"}
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("source", ["<div>" * 20000 + "x", "<a" * 50000, '<a "' * 20000 + ">", "<ul>" + "<li>t " * 20000, "<!--" * 9000, "<" * 9000, "</div>" * 9000, "<section>" * 9000 + "</div>" * 9000])
def test_odd_pages_end(source):
    page = html_extract.Page(source)
    assert isinstance(page.extract(None)[0], str)


@pytest.mark.parametrize(
    "source, text",
    [
        ('<body class="x"><div class="layout has-sidebar"><main><p>kept</p><div class="sidebar">no</div></main></div>', "kept"),
        ('<div class="widget-area"><h1>Head</h1><p>kept prose</p></div><div id="comments"><article><p>no</p></article></div>', "Head\nkept prose"),
        ('<div class="with-banner"><article><p>kept</p></article></div>', "kept"),
        ('<article><p>kept</p><div class="comments"><article class="comment"><p>no</p></article></div></article>', "kept"),
        ('<div class="comments"><p>only remarks</p></div>', ""),
    ],
)
def test_names_of_frames(source, text):
    assert html_extract.Page(source).extract(None)[0] == text


BODY = "<p>" + "A long paragraph of the article's body. " * 40 + "</p>"


@pytest.mark.parametrize(
    "source, first, last",
    [
        (f"<div class=post><h1>Title</h1><div class=post-body>{BODY}</div></div>", "Title", "body."),
        (f"<div class=post><h1><a href=/>Title</a></h1><div class=post-body>{BODY}</div></div>", "Title", "body."),
        (f"<div class=a><p>Lead one.</p><div class=b><p>Lead two.</p><div class=c>{BODY}</div><div><p>End two.</p></div></div><table><tr><td>End one.</table></div>", "Lead one.", "End one."),
        (f"<div class=nav><a href=/>Home</a></div><div class=post><h2>Title</h2><div>{BODY}</div></div><footer>no</footer>", "Title", "body."),
    ],
)
def test_nothing_beside_the_body_is_left_out(source, first, last):
    lines = html_extract.Page(source).extract(None)[0].split("\n")
    assert lines[0] == first and lines[-1].endswith(last)
    assert ("Lead two." in lines, "End two." in lines) == ("Lead two" in source, "End two" in source)


def test_a_second_template_keeps_all_its_text(spark):
    pages = [(k, f"http://h.example/{k}", f"<div class=post><h1>T{k}</h1><p>Text of page {k}.</p></div>") for k in range(6)]
    pages.append((6, "http://h.example/6", "<div class=lead><p>Other lead.</p></div><div class=post><p>One third of it.</p></div><div class=rest><p>The other third.</p></div>"))
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "T0\nText of page 0." and got[6] == "Other lead.\nOne third of it.\nThe other third."


def test_votes_go_to_the_host_path(spark):
    votes = spark.createDataFrame([("h", "a", 1.0), ("h", "b", 0.6), ("h", "b", 0.6), ("g", "y", 1.0), ("g", "x", 1.0)], "host string, path string, votes double")
    assert {(r.host, r.path) for r in html_extract.winners(votes).collect()} == {("h", "b"), ("g", "x")}

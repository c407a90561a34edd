"""Sources, scan control, diff, enrichment, manifests and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, enrich, manifest, scan
from tidemark.sources import api, snapshot, specs
from tidemark.streaming import snapshots as stream

SIDE = "source string, source_id string, title string, apply_end string, status string, content_hash string, hash_version int"


def rows(spark, *values):
    return spark.createDataFrame([("s", str(k), *v) for k, v in values], SIDE)


def kinds(df):
    return {r.source_id: (r.kind, list(r.changed_fields)) for r in df.collect()}


def test_every_situation(spark):
    prev = rows(spark, (1, ("a", None, "", "h", 2)), (2, ("a", "", None, "h", 2)), (3, ("a", "x", "o", "h", 2)), (4, ("a", "x", "o", "h", 2)), (5, ("a", "x", "o", "h", 2)), (6, ("a", "x", "o", None, None)), (8, ("a", "x", "o", None, 2))).unionByName(spark.createDataFrame([("old", "1", "t", "", "", None, None)], SIDE))
    curr = rows(spark, (1, ("a", "", None, "h", 2)), (2, ("b", "z", None, "i", 2)), (3, ("a", "x", "o", "i", 3)), (4, ("a", "x", "o", None, None)), (6, ("a", "x", "o", "h", 3)), (7, ("n", "", "", None, None)), (8, ("a", "x", "o", "", 2))).unionByName(spark.createDataFrame([("fresh", "9", "t", "", "", None, None)], SIDE))
    got = diff.classify(prev, curr)
    assert kinds(got) == {
        "1": ("UNCHANGED", []),
        "2": ("CHANGED", ["title", "apply_end", "content_hash"]),
        "3": ("CHANGED", [diff.VERSION_LABEL]),
        "4": ("NEEDS_REHASH", []),
        "5": ("GONE", []),
        "6": ("UNCHANGED", []),
        "7": ("NEW", []),
        "8": ("UNCHANGED", []),
        "9": ("NEW", []),
    }
    assert {r.source_id for r in got.where("new_source").collect()} == {"9"}
    assert {r.source_id: r["rank"] for r in diff.review(got).collect()} == {"7": 1, "9": 2, "2": 3, "3": 3, "4": 4}
    assert {r.source_id for r in diff.new(prev, curr).collect()} == {"7"}
    assert {r.source_id for r in diff.gone(prev, curr).collect()} == {"5"}
    assert {r.source_id for r in diff.changed(prev, curr).collect()} == {"2", "3"}
    fresh = kinds(diff.classify(prev, curr, carry_over=False))
    assert fresh.pop("5") == ("GONE", []) and set(map(str, fresh.values())) == {"('NEW', [])"}


def test_diff_invariants(spark):
    side = rows(spark, *((k, (f"t{k}", "", "", f"h{k}", 2)) for k in range(20)))
    assert {k for k, _ in kinds(diff.classify(side, side)).values()} == {"UNCHANGED"}
    other = rows(spark, *((k, (f"t{k % 7}", "", "", None, 2)) for k in range(10, 30)))
    assert set(kinds(diff.classify(side, other))) == {str(k) for k in range(30)}
    assert diff.classify(side, side.where("false")).count() == 0


def test_written_diff_and_unconfirmed(spark, tmp_path):
    prev, curr = rows(spark, (1, ("a", "", "", None, None)), (2, ("b", "", "", None, None))), rows(spark, (1, ("c", None, "", None, None)))
    got = diff.classify(prev, curr)
    diff.write(diff.wrapped(got, prev, curr), f"{tmp_path}/new.jsonl")
    line = json.loads(spark.read.text(f"{tmp_path}/new.jsonl").first()[0])
    assert list(line) == ["kind", "diff_status", "changed_fields", "record"] and line["record"]["apply_end"] is None and line["kind"] == line["diff_status"] == "CHANGED"
    assert json.loads(spark.read.text(f"{tmp_path}/gone_new.jsonl").first()[0])["record"]["source_id"] == "2"
    partial = spark.createDataFrame([("s", "partial")], "source string, status string")
    sure, unsure = diff.unconfirmed(got, partial)
    assert (sure.count(), unsure.count()) == (1, 1)


def test_snapshot_folder(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "a.jsonl").write_text('{"pbancSn": 7, "title": "t", "start": "2026-01-01", "deadline": "상시"}\n\n{"source": "nipa", "id": 7, "title": "u", "apply_end": ""}\n{"kind": "NEW", "record": {}, "source": "x", "id": "y"}\n{"x": 1}\n')
    (run / "new_items.jsonl").write_text("broken")
    (run / "gone_x.jsonl").write_text("broken")
    got = {(r.source, r.source_id): (r.apply_start, r.apply_end) for r in snapshot.read_snapshot(spark, str(run)).collect()}
    assert got == {("kstartup", "7"): ("2026-01-01", "상시"), ("nipa", "7"): (None, "")}
    (run / "b.jsonl").write_text('{"source": "nipa", "id": "7"}\n')
    with pytest.raises(snapshot.SnapshotError, match="repeated"):
        snapshot.read_snapshot(spark, str(run))
    (run / "b.jsonl").write_text('{"source": "nipa", \n')
    with pytest.raises(snapshot.SnapshotError, match="broken"):
        snapshot.read_snapshot(spark, str(run))
    with pytest.raises(snapshot.SnapshotError, match="no row files"):
        snapshot.read_snapshot(spark, str(tmp_path / "none"))


def scanned(spark, pages):
    return spark.createDataFrame([("s", p, k, str(i)) for p, ids in enumerate(pages, 1) for k, i in enumerate(ids)], "source string, page_no int, row_no int, id string")


def test_scan_stops_after_two_stale_pages(spark):
    got = scan.coverage(scan.crawl_stats(scanned(spark, [[1, 2]] * 5)), least=1).first()
    assert (got.stop_page, got.collected, got.duplicates, got.stop_reason, got.status) == (3, 2, 4, "no-new-2pages", "ok")
    flags = scan.with_new_flags(scanned(spark, [[1, 1], [1, 2]]))
    assert sorted((r.page_no, r.id, r.is_new) for r in flags.collect()) == [(1, "1", True), (1, "1", True), (2, "1", False), (2, "2", True)]


def test_page_cap_and_least(spark):
    fresh = scanned(spark, [[1], [2], [3]])
    capped = scan.coverage(scan.crawl_stats(fresh, max_pages=2), least=1).first()
    assert (capped.stop_reason, capped.status, capped.exit_code, capped.pages_fetched) == ("page-cap", "partial", 2, 2)
    assert scan.coverage(scan.crawl_stats(fresh), least=50).first().status == "partial"
    assert scan.coverage(scan.crawl_stats(fresh, max_pages=2), smoke=True).first().status == "ok"


def test_missing_empty_and_refused_pages_are_told(spark):
    pages = spark.createDataFrame(
        [("empty", 1, 200, None, False, "main"), ("gap", 2, 200, None, False, "main"), ("gap", 4, 200, None, False, "main"), ("no", 1, 200, None, False, "other"), ("no", 2, 403, None, False, "other"), ("net", 1, 200, None, False, "other"), ("net", 2, None, "reset", False, "other"), ("soft", 1, 200, None, True, "main")],
        "source string, page_no int, status int, error string, blocked boolean, kind string",
    )
    rows = spark.createDataFrame([(s, p, f"{s}{p}") for s, p in (("gap", 2), ("gap", 4), ("no", 1), ("net", 1), ("soft", 1))], "source string, page_no int, id string")
    got = {r.source: (r.stop_page, r.stop_reason, r.pages_fetched, r.collected, r.status, r.exit_code) for r in scan.coverage(scan.controlled(pages, rows), least=1).collect()}
    assert got == {
        "empty": (1, "parse-failure", 1, 0, "partial", 2),
        "gap": (1, "network-error", 0, 0, "partial", 2),
        "no": (2, "blocked", 1, 0, "manual", 3),
        "net": (2, "error", 1, 1, "partial", 2),
        "soft": (1, "blocked", 0, 0, "manual", 3),
    }


def test_dedup_keeps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(r.v for r in scan.dedup(df, ["k"], ["o"], "last").collect()) == ["b", "c"]
    assert sorted(r.v for r in scan.dedup(df, ["k"], ["o"], "first").collect()) == ["a", "c"]


def test_api_proof(spark):
    schema = "source string, page_no int, n_rows int, n_open int, total int"
    full = spark.createDataFrame([("a", 1, 100, 5, 250), ("a", 2, 100, 0, 250), ("a", 3, 50, 1, 250)], schema)
    assert [r.proven for r in scan.api_proof(full).orderBy("page_no").collect()] == [False, False, True]
    closed = spark.createDataFrame([("a", 1, 100, 3, 9000)] + [("a", k, 100, 0, 9000) for k in range(2, 12)], schema)
    stops = [r.page_no for r in scan.api_proof(closed).orderBy("page_no").collect() if r.stopped]
    assert stops[0] == 9 and not scan.api_proof(closed).where("proven").count()
    moved = spark.createDataFrame([("a", 1, 100, 3, 200), ("a", 2, 100, 3, 201)], schema)
    assert scan.api_proof(moved).where("total_changed").count() == 1


@pytest.mark.parametrize(
    "payload, n, total",
    [
        ('{"data":[{"a":1},{"b":2},3],"totalCount":"12"}', 2, 12),
        ('{"items":[{"a":1}],"matchCount":4}', 1, 4),
        ('{"response":{"header":{"resultCode":"00"},"body":{"totalCount":3,"items":{"item":[{"a":1},{"a":2}]}}}}', 2, 3),
        ('{"response":{"body":{"items":{"item":{"a":1}}}}}', 1, None),
        ('{"response":{"body":{"items":{}}}}', 0, None),
        ('{"response":{"body":{"items":[]}}}', 0, None),
        ('{"response":{"header":{"resultCode":"99"},"body":{"items":{"item":[{"a":1}]}}}}', None, None),
        ("{}", None, None),
        ('{"error":"x","data":[]}', None, None),
        ('{"data":[]}', 0, None),
        ("[]", None, None),
    ],
)
def test_envelopes(spark, payload, n, total):
    p = F.col("p")
    got = spark.createDataFrame([(payload,)], "p string").select(api.records(p).alias("r"), api.total(p).alias("t")).first()
    assert (None if got.r is None else len(got.r), got.t) == (n, total)


def test_api_rows(spark):
    raw = spark.createDataFrame([("7", None, "https://evil.example/", "20260731", "2026.7.1", " ", "alt", "t", "o", "Y"), (" ", "x", "", "", "", "", "", "", "", "")], "pbanc_sn string, pbancSn string, detl_pg_url string, pbanc_rcpt_end_dt string, pbanc_rcpt_bgng_dt string, supt_biz_clsfc string, biz_enyy string, biz_pbanc_nm string, sprv_inst string, rcrt_prgs_yn string")
    got = {r.source_id: r for r in api.normalise(raw, F.to_date(F.lit("2026-07-24"))).collect()}
    assert set(got) == {"7", "x"}
    r = got["7"]
    assert (r.category, r.dday, r.apply_start, r.apply_end, r.is_open) == ("alt", "D-7", "2026-07-01", "2026-07-31", True) and r.url.endswith("pbancSn=7") and "evil" not in r.url


LISTS = {
    "bizinfo": ('<tr><td>1</td><td>금융</td><td><a href="/x?pblancId=PBLN_01&a=b">T &amp; u</a></td><td>2026.07.05 ~ 2026.08.14</td><td>M</td><td>A</td><td>2026-07-01</td><td>9</td></tr><tr><td>no link</td></tr>', ("PBLN_01", "T & u", "금융", "M / A", "2026-07-05", "2026-08-14", "2026-07-01")),
    "nipa": ('<tr><a href="/home/2-2/12"><!-- c -->Ti tle</a><span class="box1"> AI </span>신청기간 : 2026-07-01 ~ 2026-07-20<span class="bco">2026-01-01</span><span class="bco"> 2026-06-30 </span></tr>', ("12", "Ti tle", "AI", "NIPA", "2026-07-01", "2026-07-20", "2026-06-30")),
    "kocca": ('<tr><span class="category_color2">게임</span><a href="/kocca/pims/view.do?intcNo=K1&amp;x=1">T</a><td data-label="접수기간">26.07.01~26.07.31</td><td data-label="공고일">26.06.30</td></tr>', ("K1", "T", "게임", "KOCCA", "2026-07-01", "2026-07-31", "2026-06-30")),
    "smtech": ('<tr><td>1</td><td>R&amp;D</td><td><a href="/front/ifg/no/notice02_detail.do;jsessionid=AB?ancmId=S1&b=2">T</a></td><td>2026-07-01 ~ 2026-07-31</td><td>2026-06-30</td></tr>', ("S1", "T", "R&D", "SMTECH(중소기업기술정보진흥원)", "2026-07-01", "2026-07-31", "2026-06-30")),
}


@pytest.mark.parametrize("name", LISTS)
def test_list_pages(spark, name):
    html, want = LISTS[name]
    got = specs.read_list(spark.createDataFrame([(1, html), (2, "<p>redesigned</p>")], "page_no int, html string"), specs.SPECS[name]).collect()
    assert [(r.source_id, r.title, r.field, r.org, r.apply_start, r.apply_end, r.reg_date) for r in got] == [want]
    assert "jsession" not in got[0].url and got[0].url.startswith("https://")


def test_main_list_skips_the_carousel(spark):
    item = '<li class="notice"><a onclick="go_view({0})"><span class="flag type04"> 사업화 </span><span class="flag day">D-3</span><p class="tit"> T{0}\n&amp; x</p><span class="flag_agency">공공</span><span class="list"><i class="a"></i>P</span><span class="list"><i></i>O</span><span class="list"><i></i>시작일자 2026.07.01</span><span class="list"><i></i>마감일자 2026-07-31</span></a></li>'
    page = f'<ul>{item.format(1)}</ul><div id="bizPbancList"><ul>{item.format(2)}<li >none</li></ul></div>'
    got = specs.read_main_list(spark.createDataFrame([(1, page), (2, item.format(3))], "page_no int, html string")).collect()
    assert [(r.source_id, r.title, r.category, r.program, r.org, r.apply_start, r.apply_end, r.agency_type, r.dday) for r in got] == [("2", "T2 & x", "사업화", "P", "O", "2026-07-01", "2026-07-31", "공공", "D-3")]


@pytest.mark.parametrize(
    "source, page, want",
    [
        ("bizinfo", '<a href="/cmm/fms/f.do?id=1&amp;n=2"><a href="/uploads/a.hwp"><a href="/cmm/fms/f.do?id=1&amp;n=2">', [("https://www.bizinfo.go.kr/cmm/fms/f.do?id=1&n=2", "f.do"), ("https://www.bizinfo.go.kr/uploads/a.hwp", "a.hwp")]),
        ("nipa", '<a href="/comm/getFile?a=1&amp;b=2">x <b>y</b>.hwp (파일크기: 1 KB)</a>', [("https://www.nipa.kr/comm/getFile?a=1&b=2", "x y .hwp")]),
        ("smtech", "<a href=\"#\" onclick=\"cfn_AtchFileDownload('AB12','','f')\">n.hwp</a>", [("https://www.smtech.go.kr/front/comn/AtchFileDownload.do?atchFileId=AB12", "n.hwp")]),
        ("kstartup", '<li class="clear"><a class="file_bg" title="x"> n.hwp </a><a href="/afile/fileDownload/K1">d</a></li><li class="clear">none</li>', [("https://www.k-startup.go.kr/afile/fileDownload/K1", "n.hwp")]),
    ],
)
def test_attachments(spark, source, page, want):
    got = spark.createDataFrame([(page,)], "h string").select(specs.attachments(F.col("h"), source).alias("f")).first().f
    assert [(f.url, f.filename) for f in got] == want


def test_versions_and_merge(spark):
    df = spark.createDataFrame([(1, "b", ["x"], ["ok"]), (2, "b", ["x"], ["failed"]), (3, "b", [], [])], "id int, body string, hashes array<string>, states array<string>")
    digest, version = enrich.versioned_hash(F.col("body"), F.col("hashes"), F.col("states"))
    assert [(r.v, r.c) for r in df.select("id", version.alias("v"), enrich.complete(F.col("states")).alias("c")).orderBy("id").collect()] == [(3, True), (2, False), (2, True)]
    base = spark.createDataFrame([(1, "old"), (1, "older"), (2, "keep")], "id int, content_hash string")
    news = spark.createDataFrame([(1, None, 2)], "id int, content_hash string, hash_version int")
    once = enrich.merge_detail(base, news, ["id"], ["content_hash", "hash_version"])
    assert sorted((r.id, r.content_hash, r.found) for r in once.collect()) == [(1, None, True), (1, None, True), (2, "keep", False)]
    again = enrich.merge_detail(once.drop("found"), news, ["id"], ["content_hash", "hash_version"])
    assert again.exceptAll(once).count() == 0


def test_lookup_never_reads_absence_as_none(spark):
    wanted = spark.createDataFrame([(k,) for k in range(4)], "k int")
    landed = spark.createDataFrame([(0, "f=1;f=2;"), (1, enrich.EMPTY_LOOKUP), (2, "layout")], "k int, page string")
    got = sorted((r.k, r.state, r.file) for r in enrich.dependent_lookup(wanted, landed, "k", "page", r"f=(\d);").collect())
    assert got == [(0, "listed", "1"), (0, "listed", "2"), (1, "empty", None), (2, "failed", None), (3, "failed", None)]


def test_manifest(spark, tmp_path):
    path = f"{tmp_path}/m.json"
    manifest.write_manifest(spark, path, [manifest.make_run("A", "partial", 2, 1, 1, "error", ["e"])], "2026-01-01T00:00:00+09:00")
    manifest.write_manifest(spark, path, [manifest.make_run("B", "ok", 0, 1, 1, "api", reported_total=5)], "t")
    made = manifest.write_manifest(spark, path, [manifest.make_run("A", "ok", 0, 2, 2, "api")], "t")
    assert [(r["source"], r["status"]) for r in made["runs"]] == [("B", "ok"), ("A", "ok")] and "reported_total" not in made["runs"][1] and made["runs"][0]["reported_total"] == 5
    (tmp_path / "m.json").write_text("{broken")
    (tmp_path / ".m.json.crc").unlink()
    again = manifest.write_manifest(spark, path, [manifest.make_run("C", "manual", 3, 0, 0, "blocked")], "t:1")
    assert len(again["runs"]) == 1 and (tmp_path / "m.json.corrupt-t1").exists() and json.loads((tmp_path / "m.json").read_text()) == again
    (tmp_path / "m.json").write_text('{"runs": {"no": "list"}}')
    (tmp_path / ".m.json.crc").unlink()
    assert manifest.write_manifest(spark, path, [], "t:1")["recovered_from_corrupt"].endswith(".corrupt-t1-2")
    (tmp_path / "m.json").write_text("{}")
    (tmp_path / ".m.json.crc").unlink()
    assert "recovered_from_corrupt" not in manifest.write_manifest(spark, path, [], "t") and not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        manifest.make_run("A", "fine", 0, 0, 0, "x")


def test_profiles(spark):
    lines = spark.createDataFrame([(1, "- 대표자: a"), (2, "text"), (3, " -- 대표자 : b:c"), (4, "- none")], "line int, value string")
    assert {r.key: r.value for r in manifest.bullets(lines).collect()} == {"대표자": "b:c"}
    full = dict.fromkeys(manifest.AXES, "x")
    assert manifest.carries_over(None, None) and manifest.carries_over(full, dict(full, other="y"))
    cases = [(None, None), (full, dict(full, other="y")), (full, None), ({"y": "z"}, full), (full, full | {"대표자": 'z"\\'}), ({}, {}), ({"대표자": "a"}, {"대표자": "a"})]
    got = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a map<string,string>, b map<string,string>")
    for r in got.select("k", manifest.carry_over(F.col("a"), F.col("b")).alias("c"), manifest.fingerprint_of(F.col("b")).alias("f")).collect():
        a, b = cases[r.k]
        assert r.c == manifest.carries_over(a, b) and (b is None or r.f == manifest.fingerprint(b))
    assert not manifest.carries_over(full, None) and not manifest.carries_over({"y": "z"}, full) and not manifest.carries_over(full, full | {"대표자": "z"})


def test_stream_agrees_with_the_batch_rules(spark, tmp_path):
    fields = "source string, source_id string, run_id string, title string, apply_start string, apply_end string, status string, content_hash string, hash_version int"
    runs = [
        [("s", "1", "r1", "a", None, None, None, "h", 2), ("s", "2", "r1", "b", None, None, None, "h", 2)],
        [("s", "1", "r2", "A", "", None, None, "h", 2), ("s", "2", "r2", "b", None, "", None, None, None), ("s", "3", "r2", "c", None, None, None, None, None)],
    ]
    for k, own in enumerate(runs):
        spark.createDataFrame(own, fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = stream.changes(spark.readStream.schema(fields).parquet(f"{tmp_path}/in"))
        q = feed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.source_id, r.kind, tuple(r.changed_fields)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("1", "CHANGED", ("title",)), ("1", "NEW", ()), ("2", "NEEDS_REHASH", ()), ("2", "NEW", ()), ("3", "NEW", ())]


def test_landed_scan_and_files(spark, tmp_path):
    from tidemark.sources import landed

    html, _ = LISTS["smtech"]
    pages = spark.createDataFrame([("smtech", p, 200, "u", html) for p in (1, 2, 3, 4)], "source string, page_no int, status int, url string, html string")
    pages.coalesce(1).write.json(f"{tmp_path}/pages")
    rows_, coverage = landed.scan_source(landed.read_pages(spark, f"{tmp_path}/pages"), "smtech")
    assert [(r.source_id, r.page_no) for r in rows_.collect()] == [("S1", 3)]
    assert [(r.stop_reason, r.pages_fetched, r.duplicates, r.status) for r in coverage.collect()] == [("no-new-2pages", 3, 2, "ok")]
    (tmp_path / "files" / "x").mkdir(parents=True)
    (tmp_path / "files" / "a.hwp").write_bytes(b"<html>")
    (tmp_path / "files" / "x" / "b.pdf").write_bytes(b"%PDF-123456")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256 is None, r.is_html) for r in landed.read_attachments(spark, f"{tmp_path}/files", cap=10).collect()}
    assert got == {"a.hwp": (6, False, True), "b.pdf": (11, True, None)}
    assert landed.numeric_ids(spark.createDataFrame([("12",), ("1x",), (None,)], "i string"), "i").count() == 1


def test_text_forms(spark):
    got = spark.createDataFrame([("u", "h", 2, "b")], "u string, h string, v int, b string").select(enrich.detail_text(F.col("u"), F.col("h"), F.col("v"), F.array().cast("array<string>"), F.col("b")).alias("t")).first().t
    assert got == "u\nCONTENT_HASH: h\nHASH_VERSION: 2\nATTACHMENTS: []\n\nb"
    side = rows(spark, (1, ("t", "e", "", None, None)))
    line = diff.report(diff.wrapped(diff.classify(side, side), side, side)).first()
    assert (line.kind, line.line) == ("UNCHANGED", "[s] t — 마감 e\n    ")
    assert manifest.outcome(["ok", "partial"]) == 2 and manifest.outcome([]) == 0 and manifest.outcome(["manual", "ok"]) == 3

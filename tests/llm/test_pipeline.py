"""The pipeline's stages take effect, each on what its predecessor kept."""

import corpus_pipeline
import pytest

unique = lambda k: " ".join(f"u{k}x{j}" for j in range(80))
BODY = "the quick brown fox number {} jumps over a lazy dog while {} other animals watch it from the old stone bridge near town {}"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    text = lambda k: " ".join(BODY.format(k, k + 1, k + 2) + f" w{k}{j}" for j in range(3)) if k else ""
    passage = " ".join(f"p{k}" for k in range(60))
    item = " ".join(f"q{k}" for k in range(12))
    unique = lambda k: " ".join(f"u{k}x{j}" for j in range(80))
    rows = [(k, unique(k), "en", "s", 1) for k in range(8)]
    rows += [(20, unique(0), "en", "s", 1), (21, unique(1).replace("u1x7 ", "edit "), "en", "s", 1), (22, "too short", "en", "s", 1), (23, None, "en", "s", 1)]
    rows += [(30, unique(30) + " " + passage, "en", "s", 1), (31, unique(31).replace(" u31x9 ", "\n\tu31x9  ") + "\n" + passage + "\n\nthe end", "en", "s", 1), (32, unique(32) + " " + item + " tail", "en", "s", 1), (33, unique(33) + " " + item + " more i1 i2 i3", "en", "s", 1)]
    del text
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "i1 i2 i3")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality_rules"] == {*range(8), 20, 21, 30, 31, 32, 33}
    assert ids["jaccard_join"] == {*range(8), 30, 31, 32, 33}
    assert ids["substring_dedup"] == ids["jaccard_join"]
    texts = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert "p5 p6" in texts[30].text
    assert texts[31].text == unique(31).replace(" u31x9 ", "\n\tu31x9  ") + "\nthe end"
    assert texts[31].n_chars == len(texts[31].text) and texts[2].text == " ".join(f"u2x{j}" for j in range(80))
    assert ids["benchmark_decontamination"] == ids["substring_dedup"] - {33}
    assert "q5" not in {r.doc_id: r for r in seen["benchmark_decontamination"].collect()}[32].text
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]


def test_run_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

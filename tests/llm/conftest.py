import random

import pytest

DOCS = "doc_id long, text string, lang string, n_words string, kept_text string, items string"


def make_docs(seed: int = 1, n: int = 60) -> list[tuple]:
    """Small texts with copies, near copies, shared passages, repeats, odd spaces, nulls and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "Dé", "ee", "ff", "g7", "日本", "x" * 40, "#", "don't"]
    word = lambda: r.choice(vocabulary) + (str(r.randrange(400)) if r.random() < 0.7 else "")
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(r.choice([1, 4, 5, 12, 13, 14, 40, 90, 200]))) for _ in range(n)]
    for k in range(0, n, 4):
        texts[k] = texts[k // 2]
    for k in range(1, n, 5):
        words = texts[k - 1].split(" ")
        words[r.randrange(len(words))] = "edit"
        texts[k] = " ".join(words)
    for k in range(2, n, 7):
        texts[k] += "\t" + passage + "\n" + word()
    texts[3] = passage + "\n" + passage
    texts[5], texts[6], texts[9], texts[11], texts[13] = None, "", " \t\n\x0b\x0c\r", "same " * 300, "y" * 900
    rows = [(i, t, "en", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (8, "another text under a known id " + passage, "en", None, None, None), (None, texts[8], None, None, None, None), (None, passage, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

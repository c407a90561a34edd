"""Corpus pipeline over documents: each stage applies one operator to all that its predecessor kept.

Quality rules drop what they reject; of each group of near duplicates the document with the smallest doc_id
stays; repeated passages are cut, with the white space after them, from all but their first document, whose
lines otherwise stay; documents that hold two or more benchmark
items are dropped and a single item's passage is cut out; what is left is packed into sequences of tokens, whose
ids the result holds.

A stage that changes a text sets n_chars to its new length. Defined results for odd rows (nulls, empty and
repeated ones) are those of the operators; no stage but the first two and the fourth drops a row, and those
drop only rows that their operator decides against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, packing, quality, substring_dedup
from tidemark.llm.staging import staged


def _with_text(made: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs from made, with another text."""
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return made.select([own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).where(F.col("rejected_by").isNull()).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(docs, spans=False, layout=True)
    return _with_text(made, docs, F.when(F.col("n_removed") > 0, F.col("cut_text")).otherwise(F.col("text")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("items") < 2)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["begin"]), F.array(F.length("text").cast("long")))
    left = F.array_join(F.zip_with(begins, ends, lambda lo, hi: F.substring(F.col("text"), (lo + 1).cast("int"), (hi - lo).cast("int"))), "")
    return _with_text(found, docs, F.when(F.size("spans") > 0, left).otherwise(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]

#: The cascade's cost order aside, tokens and packing plans have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

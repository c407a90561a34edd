"""Minimum per group and connected components, for groups and components of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

SALTS = 64


def with_least(df: DataFrame, key: str, value: str, name: str, by: str, salts: int = SALTS) -> DataFrame:
    """df with the least value of each key's rows. Rows of a hot key are dealt by a hash of the column `by`:
    each (key, salt) has one row on the way up and on the way back."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias("__part"))
    whole = parts.groupBy(key).agg(F.min("__part").alias(name))
    return salted.join(parts.join(whole, key).select(key, "__salt", name), [key, "__salt"]).drop("__salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node it is connected to), for all nodes of the edges, by alternating
    large-star and small-star steps. Each round is written to the shared folder."""
    e = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        # every edge now leads from a node down to a smaller one
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()

"""Relational chat formatting: Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one
block by comparing each array element with its neighbours; blocks are concatenated. The template:

    <|turn|>role<|text|>first text<|next|>second text<|end|>

A control string starts with "<|". Inside roles and texts a backslash is written twice and "<|" becomes
"<\\|", so no text can hold a control string, and one pass over backslash pairs restores it exactly.

Results per conversation: segments (array of struct<text, loss>, whose texts joined give formatted; loss
marks the escaped assistant texts, which are what training learns from) and formatted.

Defined results: a null text or role counts as empty; rows without conv_id form one conversation; turns
are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one order and all
stay; an empty table gives an empty result. A conversation is one output row by definition, so its turns
meet in one task; their order and merging cost n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
LEARNED = "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\|\|)", "$1")


def format_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED) -> DataFrame:
    """key, segments and formatted, one row for each conversation."""
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(own)).alias("turns"))

    def block(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        opening = F.when(before.isNull() | (before != t["role"]), F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        closing = F.when(after.isNull() | (after != t["role"]), F.lit(END)).otherwise(F.lit(""))
        plain = F.lit(False)
        return F.array(
            F.struct(opening.alias("text"), plain.alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), (t["role"] == learned).alias("loss")),
            F.struct(closing.alias("text"), plain.alias("loss")),
        )

    segments = turns.select(F.col(key), F.filter(F.flatten(F.transform("turns", block)), lambda s: (s["text"] != "") | s["loss"]).alias("segments"))
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, that a formatted conversation holds."""
    blocks = F.transform(F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != ""), lambda b: F.substring(b, F.lit(len(TURN) + 1), F.length(b)))

    def turns(b: Column) -> Column:
        parts = F.split(b, r"<\|text\|>")
        return F.transform(F.split(parts[1], r"<\|next\|>"), lambda t: F.struct(unescaped(parts[0]).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted output, with the probe conversation -1."""
    probe = "</s>[INST] ok [/INST]"
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = format_turns(own.unionByName(extra))
    back = made.select("conv_id", read_back(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: formatted_chars follows from the template: its control strings and the doubled escapes.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS etext, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS erole,
    lag(role) OVER w IS DISTINCT FROM role AS opens
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN opens THEN 8 + length(erole) + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

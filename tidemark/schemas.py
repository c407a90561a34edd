"""Schemas of the announcement model."""

from __future__ import annotations

from pyspark.sql import types as T

ATTACHMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "filename", "download_status", "download_reason", "sha256", "local_path")])

ANNOUNCEMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "source_id", "title", "field", "org", "category", "program", "agency_type", "dday", "apply_start", "apply_end", "reg_date", "status", "url", "content_hash")]
    + [
        T.StructField("hash_version", T.IntegerType()),
        T.StructField("attachments_complete", T.BooleanType()),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
        T.StructField("run_id", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("row_no", T.IntegerType()),
    ]
)

#: What a raw snapshot line may hold: both list shapes, wrapper markers, and detail columns.
RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pbancSn", "source", "id", "title", "category", "dday", "program", "org", "start", "deadline", "agency_type", "field", "apply_start", "apply_end", "reg_date", "status", "url", "content_hash", "kind", "record")]
    + [T.StructField("hash_version", T.IntegerType()), T.StructField("attachments_complete", T.BooleanType()), T.StructField("attachments", T.ArrayType(ATTACHMENT))]
)

PAGE = T.StructType([T.StructField("source", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("status", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])

MANIFEST_RUN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("pages_fetched", T.LongType()),
        T.StructField("collected", T.LongType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("cutoff", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("reported_total", T.LongType()),
        T.StructField("duplicates", T.LongType()),
    ]
)

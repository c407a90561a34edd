"""Where intermediate tables go, and how batches of texts are cut to bounded pieces."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint
    folder. Only a local session, where every folder is shared, may do without either."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's own switch: shuffle files of a query are removed when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """df written once as Parquet to the shared folder, or the folder named, and read back: later stages read the
    files, so a lost executor costs a re-read and never a recomputation of what led here. Shuffle files that led
    to the table are removed once it stands, as nothing reads them again."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def fresh(df: DataFrame, *made: str) -> DataFrame:
    """df without columns whose names the operator is about to give to its own results."""
    taken = {m.lower() for m in made}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def cut(batches, column: str, limit: int = 2 << 20):
    """The batches in slices of about `limit` bytes of the column's text; one longer text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += size
        yield batch.slice(begin)


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)

"""A stream of announcement rows against the last state of each key: NEW, CHANGED, NEEDS_REHASH as rows arrive.

GONE can only be told when a run is complete, so it isn't part of the stream: compare the finished run with
operators.diff. State is one small row a key, partitioned by (source, source_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.diff import CHANGED, FIELDS, NEW, REHASH, SAME, VERSION_LABEL

OUT = "source string, source_id string, kind string, changed_fields array<string>"
STATE = ", ".join(f"{f} string" for f in FIELDS) + ", content_hash string, hash_version int"


def verdict(old: tuple | None, new: tuple) -> tuple[str, list[str]]:
    """Kind and changed fields of two states (fields, hash, version); empty counts as null."""
    if old is None:
        return NEW, []
    (*of, oh, ov), (*nf, nh, nv) = old, new
    listed = [f for f, a, b in zip(FIELDS, of, nf) if (a or None) != (b or None)]
    if oh and nh and ov == nv and oh != nh:
        listed.append("content_hash")
    if not listed and oh and nh and ov != nv:
        listed = [VERSION_LABEL]
    return (CHANGED, listed) if listed else (REHASH, []) if oh and not nh else (SAME, [])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = tuple(state.get) if state.exists else None
    out = []
    for batch in batches:
        for row in batch.sort_values("run_id", kind="stable").itertuples(index=False):
            new = tuple(None if pd.isna(v) or v == "" else v for v in (*(getattr(row, f) for f in FIELDS), row.content_hash, row.hash_version))
            new = (*new[:-1], None if new[-1] is None else int(new[-1]))
            kind, fields = verdict(old, new)
            if kind != SAME:
                out.append((*key, kind, fields))
            old = new
    if old is not None:
        state.update(old)
    if out:
        yield pd.DataFrame(out, columns=["source", "source_id", "kind", "changed_fields"])


def changes(rows: DataFrame) -> DataFrame:
    """Change feed of a stream of (source, source_id, run_id, compared fields, content_hash, hash_version)."""
    held = rows.select("source", "source_id", "run_id", *FIELDS, "content_hash", "hash_version")
    return held.groupBy("source", "source_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

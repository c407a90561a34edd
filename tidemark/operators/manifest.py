"""Run manifests and profiles: small documents that the driver reads and writes as a whole."""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import chain, count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The profile's axes; a change in one invalidates earlier verdicts.
AXES = ("창업 단계", "지역 연고", "대표자", "필요한 것")
MANIFEST_VERSION = 1


def upsert(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """new rows, and old rows of other keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def earlier_runs(text: str) -> list[dict] | None:
    """The runs of a written manifest, none if it lists none; None if it can't be understood: no JSON object, or
    runs that are no list."""
    try:
        held = json.loads(text)
    except ValueError:
        return None
    runs = held.get("runs", []) if isinstance(held, dict) else None
    return [r for r in runs if isinstance(r, dict)] if isinstance(runs, list) else None


def write_manifest(spark: SparkSession, path: str, runs: list[dict], generated_at: str) -> dict:
    """Replace the runs of the same sources in the manifest at path, through the file system of the path: written
    under a name of its own, then renamed over the old one, so that readers see one or the other. A manifest that
    can't be understood is kept under .corrupt-<time>, with a number where that name is taken."""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path
    where = name(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    before, corrupt = [], None
    if fs.exists(where):
        before = earlier_runs("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
        if before is None:
            before, base = [], f"{path}.corrupt-{generated_at.replace(':', '')}"
            corrupt = next(c for c in chain([base], (f"{base}-{k}" for k in count(2))) if not fs.exists(name(c)))
            fs.rename(where, name(corrupt))
    named = {r["source"] for r in runs}
    made = {"manifest_schema_version": MANIFEST_VERSION, "generated_at": generated_at, "runs": [r for r in before if r.get("source") not in named] + runs}
    if corrupt:
        made["recovered_from_corrupt"] = corrupt
    temporary = name(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(made, ensure_ascii=False, indent=2).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()) if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, where, overwrite)
    return made


def make_run(source: str, status: str, exit_code: int, pages_fetched: int, collected: int, stop_reason: str, errors: list[str] | None = None, **more) -> dict:
    """One run of a manifest; reported_total, duplicates and cutoff only where given."""
    if status not in ("ok", "partial", "manual", "inactive"):
        raise ValueError(f"unknown status {status}")
    return {"source": source, "status": status, "exit_code": exit_code, "pages_fetched": pages_fetched, "collected": collected, "stop_reason": stop_reason, "cutoff": more.pop("cutoff", None), "errors": errors or []} | {k: v for k, v in more.items() if v is not None}


def bullets(lines: DataFrame, text: str = "value", order: str = "line") -> DataFrame:
    """key and value of '- key: value' lines; the last line of a key counts."""
    body = F.regexp_replace(F.trim(F.col(text)), "^-+", "")
    found = lines.where(F.startswith(F.trim(F.col(text)), F.lit("-")) & F.contains(body, F.lit(":"))).select(F.col(order), F.trim(F.substring_index(body, ":", 1)).alias("key"), F.trim(F.regexp_extract(body, "(?s)^[^:]*:(.*)$", 1)).alias("value"))
    return found.groupBy("key").agg(F.max_by("value", order).alias("value"))


def fingerprint(fields: dict[str, str]) -> str:
    """Sixteen hex digits over the axes; a missing one counts as null."""
    return hashlib.sha256(json.dumps({k: fields.get(k) for k in AXES}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def carries_over(old: dict[str, str] | None, new: dict[str, str] | None) -> bool:
    """Do earlier verdicts still hold: no profile at all, or two with a filled axis each and one fingerprint."""
    if old is None and new is None:
        return True
    if not old or not new:
        return False
    return all(any(p.get(a) for a in AXES) for p in (old, new)) and fingerprint(old) == fingerprint(new)


def fingerprint_of(fields: Column) -> Column:
    """fingerprint() of a map column, as an expression."""
    value = lambda axis: F.coalesce(F.to_json(F.array(F.try_element_at(fields, F.lit(axis)))), F.lit("[null]"))
    spelled = F.concat_ws(", ", *(F.concat(F.lit(f'"{axis}": '), F.regexp_replace(value(axis), r"^\[|\]$", "")) for axis in sorted(AXES)))
    return F.substring(F.sha2(F.encode(F.concat(F.lit("{"), spelled, F.lit("}")), "UTF-8"), 256), 1, 16)


def carry_over(old: Column, new: Column) -> Column:
    """carries_over() of two map columns, null where there is no profile."""
    filled = lambda p: F.exists(F.array(*(F.coalesce(F.try_element_at(p, F.lit(a)), F.lit("")) for a in AXES)), lambda v: v != "")
    return F.when(old.isNull() | new.isNull(), old.isNull() & new.isNull()).otherwise(filled(old) & filled(new) & (fingerprint_of(old) == fingerprint_of(new)))


#: Exit codes of run states.
EXIT_CODES = {"ok": 0, "partial": 2, "manual": 3}


def outcome(statuses: list[str]) -> int:
    """The exit code of a run over several sources: the worst of theirs."""
    return max((EXIT_CODES[s] for s in statuses if s in EXIT_CODES), default=0)

"""Stores and sinks of runs: cached responses, locks, manifests, reports, sheets with bad bytes."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.sources.tables import load_labels

MANUAL = ("<!-- manual:start -->", "<!-- manual:end -->")
RESPONSES = "key string, value string, meta string, at timestamp"


def load_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A label sheet, bad bytes as U+FFFD, and the files (path) that are not valid UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    bad = files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")
    return load_labels(spark, path), bad


def put_responses(rows: DataFrame, path: str) -> None:
    """Add responses (key, value, meta) to a store; the latest of a key counts."""
    rows.select("key", "value", "meta", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """key, value, meta: the latest of each key."""
    last = F.max_by(F.struct("value", "meta"), F.struct("at", "value")).alias("v")
    return spark.read.schema(RESPONSES).parquet(path).groupBy("key").agg(last).select("key", "v.*")


def cached(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with the value of their key, null where there is none."""
    return requests.join(store.select("key", "value"), "key", "left")


def todo(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests whose key the store lacks: what a resumed run still has to do."""
    return requests.join(store.select("key"), "key", "left_anti")


def check_lock(spark: SparkSession, path: str, sha256: str) -> None:
    """Raise unless the file at path has that digest."""
    found = [r.h for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).take(2)]
    if found != [sha256.strip().lower()]:
        raise ValueError(f"{path} differs from its lock")


def append_run(path: str, run: dict) -> dict:
    """Add a run to a manifest {"runs": [...]}; a manifest that is one bare run becomes its first."""
    file = Path(path)
    old = json.loads(file.read_text("utf-8")) if file.exists() else {"runs": []}
    new = {"runs": [*(old["runs"] if "runs" in old else [old]), run]}
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(new, indent=1), "utf-8")
    return new


def markdown(df: DataFrame, most: int = 500) -> str:
    """A small frame as a Markdown table; more than ``most`` rows raise, for reports are not a way to collect tables."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report table")
    safe = lambda v: str(v).replace("\n", " ").replace("|", "\\|")
    body = [df.columns, ["---"] * len(df.columns), *([safe(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in body)


def write_report(path: str, parts: list[str], note: str = "") -> str:
    """Write parts and, last, the hand-written block: that of the file as it is, or ``note`` where there is none."""
    file, (start, end) = Path(path), MANUAL
    old = file.read_text("utf-8") if file.exists() else ""
    kept = old[old.index(start) + len(start) : old.index(end)] if start in old and end in old else f"\n{note}\n"
    text = "\n\n".join([*parts, f"{start}{kept}{end}"]) + "\n"
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, "utf-8")
    return text


def cache_key(request: dict) -> str:
    """The digest of a request, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

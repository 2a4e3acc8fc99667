"""Calls of a text model over a table of requests: cached, repaired once, and resumed where they stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.sources import stores
from threadlens.sources.tables import cut

REPAIR = "The answer was not valid JSON with the keys {keys}. Answer again with that JSON object and nothing else."


def valid(value: str | None, keys: tuple[str, ...]) -> str | None:
    """The outermost JSON object of an answer, if it has the keys; else null."""
    if value is None:
        return None
    start, end = value.find("{"), value.rfind("}")
    if start < 0 or end < start:
        return None
    try:
        found = json.loads(value[start : end + 1])
    except json.JSONDecodeError:
        return None
    return json.dumps(found, sort_keys=True) if isinstance(found, dict) and set(keys) <= set(found) else None


def complete(requests: DataFrame, store: str, ask: Callable[[str], str], keys: tuple[str, ...] = (), rounds: int = 16) -> DataFrame:
    """requests (key, prompt, ...) with value: the answer of ``ask`` to each prompt, null where it isn't valid twice.

    Only requests whose key the store lacks are asked, in ``rounds`` jobs, each of a share of the keys by hash. A round's answers are stored,
    with the number of calls, as the round ends and before any is used: a run that is stopped loses those of one round at
    most, and the next run goes on behind the stored ones. With ``keys``, answers must be JSON with these keys; one that isn't is
    asked for once more with a note. ``ask`` runs in tasks, in batches, and must be picklable; it may answer null. An ``ask`` that raises
    ends the run.
    """
    spark = requests.sparkSession

    def answer(prompt: str) -> tuple[str | None, int]:
        said = ask(prompt)
        if not keys:
            return said, 1
        if (good := valid(said, keys)) is not None:
            return good, 1
        return valid(ask(f"{prompt}\n\n{REPAIR.format(keys=', '.join(keys))}"), keys), 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [answer(p) for p in frame["prompt"]]
            yield pd.DataFrame({"key": frame["key"], "value": [v for v, _ in got], "meta": [json.dumps({"calls": n}) for _, n in got]})

    distinct = requests.select("key", "prompt").dropDuplicates(["key"])
    try:
        known = stores.responses(spark, store)
        distinct = stores.todo(distinct, known)
    except Exception as error:  # no store yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    share = F.pmod(F.xxhash64("key"), F.lit(rounds)).alias("share")
    waiting = cut(distinct.select("key", "prompt", share).repartition("share"))
    for r in sorted(x["share"] for x in waiting.select("share").distinct().collect()) or [0]:  # at most ``rounds``; [0] makes the store
        part = waiting.filter(F.col("share") == r).repartition(spark.sparkContext.defaultParallelism)
        stores.put_responses(part.mapInPandas(run, "key string, value string, meta string"), store)
    return stores.cached(requests, stores.responses(spark, store))


def compared(requests: DataFrame, store: str, candidates: dict[str, Callable[[str], str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """candidate and the columns of ``complete`` for each of several models on the same requests, each with its own store."""
    found = None
    for name, ask in candidates.items():
        one = complete(requests, f"{store}/{name}", ask, keys).withColumn("candidate", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found

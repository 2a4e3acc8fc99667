"""Periodic runs of words, found by probing a harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least POWERS * q and ``least`` words long, that no
neighbouring word extends. Whatever its place, a run of period p holds POWERS grid points jp, (j+1)p, ... in a row, so it is
enough to compare the words at jp and (j+1)p for all p and j: n/1 + n/2 + ... probes of a text of n words. Points whose
probe and whose next probe agree are extended to both sides by comparing arrays in chunks that double. Periods rise, and
grid points inside a run already found are passed over: those of its own period, and those of multiples of it, which would
only find the same run again.

Texts are split and numbered in Arrow batches; each text is one task's, in memory that grows with the text (probes are
made ``PROBES`` at a time).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import blocks, let, table, text_bytes

LEAST, POWERS = 24, 3
PROBES = 1 << 17
CHUNK = 64
#: Bytes of text, about, of an output batch.
BLOCK = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"
_RUN = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two equally long arrays agree."""
    done, size = 0, CHUNK
    while done < len(a):
        differ = a[done : done + size] != b[done : done + size]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 2
    return len(a)


def _survivors(w: np.ndarray, low: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Grid points i and their periods p from ``low`` on with equal words at i, i + p and i + 2p, and the next period."""
    periods = np.arange(low, min(top, low + PROBES) + 1)
    counts = (len(w) - 1) // periods
    many = max(1, int(np.searchsorted(np.cumsum(counts), PROBES, "right")))
    periods, counts = periods[:many], counts[:many]
    p = np.repeat(periods, counts)
    i = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
    same = w[i] == w[i + p]
    at = np.flatnonzero(same[:-1] & same[1:] & (p[:-1] == p[1:]))
    return i[at], p[at], low + many


def _outside(i: np.ndarray, p: np.ndarray, run: tuple[int, int, int]) -> np.ndarray:
    """Grid pairs that don't lie in the run at a multiple of its period."""
    start, length, period = run
    return (i < start) | (i + p >= start + length) | (p % period != 0)


def find_runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of an array, by start, then period."""
    runs: list[tuple[int, int, int]] = []
    low, top = 1, len(w) // POWERS if len(w) >= least else 0
    while low <= top:
        i, p, low = _survivors(w, low, top)
        for run in runs:
            keep = _outside(i, p, run)
            i, p = i[keep], p[keep]
        while len(i):
            at, period = int(i[0]), int(p[0])
            stop = at + _agreeing(w[at : len(w) - period], w[at + period :])
            start = at - _agreeing(w[:at][::-1], w[period : at + period][::-1])
            length = stop - start + period
            keep = (p != period) | (i >= stop)
            if length >= max(least, POWERS * period):
                runs.append((start, length, period))
                keep &= _outside(i, p, runs[-1])
            i, p = i[keep], p[keep]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length/period, compared exactly; of equal ones that of the least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run contains behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = text_bytes(whole.column(1))
            for a, b in blocks(map(len, texts), BLOCK):
                counts, sizes, flat, best, out = [], [], [], [], []
                for text in texts[a:b]:
                    words = text.split()
                    found = find_runs(numbered(words), least)
                    counts.append(len(words))
                    if found:
                        words = [words[k] for k in np.flatnonzero(kept(len(words), found))]
                    sizes.append(len(found))
                    flat += found
                    best.append(strongest(found))
                    out.append(b" ".join(words))
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c) for c in columns], [k for k, _ in _RUN]),
                )
                top = pa.array([r and dict(zip([k for k, _ in _RUN], r, strict=True)) for r in best], pa.struct(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(a, b - a), pa.array(counts, pa.int64()), listed, top, pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    return run


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in words; by start, then period), strongest (the run of the greatest
    length/period, null without runs) and collapsed (the words but those that a run contains behind its first period, joined
    by one space) of each row of documents (doc_id of any type, text).

    Null texts are empty: no words, no runs, an empty collapsed text. Rows that repeat a doc_id or a text are rows of their
    own. An empty table gives an empty one. Other columns are ignored, whatever their names. No shuffle: a row's result
    depends on its text alone.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(least), f"doc_id {kind}, n_words long, runs array<{_RUN_SQL}>, strongest {_RUN_SQL}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the runs that the query's contract plants: with h = crc32 of the decimal doc_id and n words, where h is a
    multiple of 10 and n > 0, each word i >= a becomes word a + (i - a) % p. Null ids and null texts stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"))
        word = lambda q: F.concat_ws(" ", F.transform(words, lambda w, i: F.when(i < q["a"], w).otherwise(F.get(words, q["a"] + (i - q["a"]) % q["p"]))))
        return let(place, word)

    split = F.regexp_extract_all(text.cast("string"), F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), let(split, repeated)).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )

"""Periodic runs against a quadratic search, the planted texts, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import periodic

SCHEMA = "doc_id long, text string, runs string, collapsed string, n_words string"


def slow_runs(words, least=24):
    """All (start, length, period) by definition: maximal stretches of each period, the least period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 3 * q):
                found.setdefault((i, length), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, plant=True):
    words = re.findall(periodic.WORD, text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    start, length, q = best or (None, None, None)
    milli = None if best is None else 1000 * length // q
    return (doc_id, len(runs), start, length, q, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("probes", [periodic.PROBES, 50])
def test_runs_equal_a_quadratic_search(monkeypatch, probes):
    monkeypatch.setattr(periodic, "PROBES", probes)
    draw = random.Random(5)
    for k in range(300):
        letters = draw.choice([1, 2, 3, 8, 40])
        words = [draw.randrange(letters) for _ in range(draw.randrange(0, 160))]
        for _ in range(draw.randrange(4)):
            at, q = draw.randrange(len(words) + 1), draw.randrange(1, 30)
            words[at:at] = [words[0] if not words else draw.choice(words) for _ in range(q)] * draw.randrange(1, 8) if words else []
        assert periodic.find_runs(np.array(words, np.int32)) == slow_runs(words), k


def test_runs_of_runs_and_chunk_edges():
    for n in (23, 24, 63, 64, 65, 127, 128, 200, 5000):
        assert periodic.find_runs(np.zeros(n, np.int32)) == ([(0, n, 1)] if n >= 24 else [])
    # a period of a power, next to the same letters at another period
    words = [0] * 30 + [1] + ([0] * 30 + [1]) * 5 + [0, 1] * 40
    assert periodic.find_runs(np.array(words, np.int32)) == slow_runs(words)


def test_kept_drops_what_lies_behind_first_periods():
    runs = [(0, 24, 1), (10, 40, 10)]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert [i for i in range(60) if not periodic.kept(60, runs)[i]] == sorted(gone)


def test_query_rows_equal_brute_force(spark, tmp_path):
    draw = random.Random(9)
    vocabulary = ["a", "b", "Ab", "cé", "𝕏", "the", "of"]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 300))), "x", "x", "x") for i in range(150)]
    rows += [(200, None, "x", "x", "x"), (201, "", "x", "x", "x"), (202, " \t\n ", "x", "x", "x"), (203, "spam " * 3000, "x", "x", "x")]
    rows += [(204, "one two\x0bthree\x0cfour " * 50, "x", "x", "x"), (204, "one two\x0bthree\x0cfour " * 50, "x", "x", "x")]
    rows += [(205, "no break space " * 30, "x", "x", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic.op11_periodic(spark, str(tmp_path)).drop("n_words").collect()
    assert sorted(map(tuple, found), key=str) == sorted((slow_row(r[0], r[1]) for r in rows), key=str)


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, "x " * 30, "", "", ""), (None, None, None, None, None), (1, "z " * 10, "", "", "")]
    found = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in found) == [(0, 0, 0, ""), (0, 30, 1, "x"), (1, 10, 0, " ".join("z" * 10))]
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    strings = spark.createDataFrame([("k", "y " * 40)], "doc_id string, text string")
    assert periodic.periodic_runs(strings).select("doc_id", F.col("strongest.length")).collect()[0][:] == ("k", 40)
    assert periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA), least=40).filter(F.size("runs") > 0).count() == 0


def test_very_long_texts(spark):
    long = " ".join(str(i % 7919) for i in range(120_000))
    found = periodic.periodic_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in found.runs] == [(0, 120_000, 7919)] and found.n_words == 120_000

"""Exact quantiles against NumPy."""

import random

import numpy as np
import pytest

from threadlens.operators import quantiles

SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]


def groups():
    draw = random.Random(1)
    return {
        "one": [3.5], "two": [1.0, 2.0], "ties": [draw.randrange(4) for _ in range(500)], "far": [draw.gauss(0, 1) * 10 ** draw.randrange(-9, 9) for _ in range(700)],
        "equal": [7.0] * 90, "near": [1.0 + k * 2.0**-52 for k in range(50)], "skewed": [0.0] * 400 + [1e300, -1e300, 5e-324],
    }


@pytest.mark.parametrize("parts, broadcast", [(1024, 100_000), (3, 100_000), (64, 0)])
def test_groups_equal_numpy(spark, monkeypatch, parts, broadcast):
    monkeypatch.setattr(quantiles, "BROADCAST", broadcast)
    rows = [(k, float(x)) for k, xs in groups().items() for x in xs] + [("one", None), ("none", None), ("two", float("nan"))]
    found = quantiles.exact(spark.createDataFrame(rows, "k string, x double").repartition(5), "x", SHARES, ["k"], parts).collect()
    got = {(r.k, r.q): r.value for r in found}
    want = {(k, q): float(np.quantile(xs, q)) for k, xs in groups().items() for q in SHARES}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-12, abs=1e-300), key


def test_all_rows_and_none(spark):
    rows = spark.range(1, 1002).withColumnRenamed("id", "x")
    assert [tuple(r) for r in quantiles.exact(rows, "x", [0.7, 0.5]).orderBy("q").collect()] == [(0.5, 501.0), (0.7, 701.0)]
    assert quantiles.exact(rows.limit(0), "x", [0.5]).count() == 0

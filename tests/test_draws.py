"""Draws against a serial greedy loop."""

import random

import pytest
from pyspark.sql import functions as F

from test_similarity import cosine, slow_vectors
from threadlens.operators import draws


def order(spark, ids, seed="42"):
    rows = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("h", draws.hashed(F.lit(seed), F.col("id")))
    return [r.id for r in rows.orderBy("h", "id").collect()]


@pytest.fixture(scope="module")
def pool():
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 9))) for _ in range(150)]
    rows = []
    for i in range(160):
        text = " ".join(draw.choice(words) for _ in range(30))
        if i % 4 == 1:
            text = rows[i - 1][2]
        if i % 4 == 2:
            text = rows[i - 2][2] + " " + draw.choice(words)
        rows.append((i, draw.choice([None, *range(60)]), text, i % 3))
    return [*rows, (500, 900, None, 0), (501, 901, None, 0), (502, 902, "", 1)]


def serial(spark, pool, fills, kept, near=0.95):
    by_id = {r[0]: r for r in pool}
    ids = list(by_id)
    texts = [by_id[i][2] for i in ids]
    v = slow_vectors(texts + kept)
    kept_v, v = v[len(texts) :], dict(zip(ids, v, strict=False))
    picked, threads, out = [], set(), []
    for name, fits, n in fills:
        got = 0
        for i in order(spark, ids):
            if got == n:
                break
            if i in picked or not fits(by_id[i]) or by_id[i][1] in threads:
                continue
            if near and (any(cosine(v[i], k) >= near for k in kept_v) or any(cosine(v[i], v[j]) >= near for j in picked)):
                continue
            picked.append(i)
            threads |= {by_id[i][1]} - {None}
            out.append((i, name, len(out) + 1))
            got += 1
    return out


@pytest.mark.parametrize("near, window", [(0.95, 4), (None, 1)])
def test_draw_equals_a_serial_loop(spark, pool, near, window):
    kept = [pool[12][2], "something else"]
    frame = spark.createDataFrame(pool, "id long, thread long, text string, kind int")
    fills = [("random", F.lit(True), 12), ("ones", F.col("kind") == 1, 9), ("zeros", F.col("kind") == 0, 70)]
    plain = [("random", lambda r: True, 12), ("ones", lambda r: r[3] == 1, 9), ("zeros", lambda r: r[3] == 0, 70)]
    out = spark.createDataFrame([(k,) for k in kept], "text string") if near else None
    got = draws.draw(frame, fills, near=near, kept_out=out, strict=False, window=window)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == serial(spark, pool, plain, kept if near else [], near)


def test_a_quota_that_falls_short_raises(spark, pool):
    frame = spark.createDataFrame(pool, "id long, thread long, text string, kind int")
    with pytest.raises(ValueError, match="only .* of 999 candidates for all"):
        draws.draw(frame, [("all", F.lit(True), 999)], near=None)


def test_long_chains_of_conflicts(spark):
    n = 60
    items = spark.createDataFrame([(i, i, None, str(i)) for i in range(n)], "id long, place long, thread long, text_id string")
    links = spark.createDataFrame([(str(i), str(j)) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "a string, b string")
    shuffled = items.withColumn("place", (F.col("id") * 37) % 61)
    taken = set()
    for i in sorted(range(n), key=lambda i: i * 37 % 61):
        if not {i - 1, i + 1} & taken:
            taken.add(i)
    assert {r.id for r in draws.independent(shuffled, links).collect()} == taken

"""Similar texts against all pairs, and how few pairs meet."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadlens.operators import retrieval
from threadlens.plans.operator_queries import OPERATOR_QUERIES


def slow_vectors(texts, max_df=0.2):
    out = []
    for t in texts:
        words = [f" {w} " for w in (t or "").lower().split()]
        found = Counter()
        for w in words:
            for n in range(3, 6):
                if len(w) <= n:
                    found[w] += 1
                    break
                found.update(w[i : i + n] for i in range(len(w) - n + 1))
        out.append(found)
    df = Counter(g for c in out for g in c)
    n = len(texts)
    vectors = [{g: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, f in c.items() if df[g] <= max_df * n} for c in out]
    return [{g: w / math.sqrt(sum(x * x for x in v.values())) for g, w in v.items()} for v in vectors]


def cosine(a, b):
    return sum(w * b[g] for g, w in a.items() if g in b)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(120)]
    made = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(90)]
    for i in range(0, 60, 3):  # near copies, exact copies
        parts = made[i].split()
        parts[draw.randrange(len(parts))] = draw.choice(words)
        made.append(" ".join(parts))
        made.append(made[i])
    return [*made, "", None, "  ", "q"]


def test_the_maximum_equals_all_pairs(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = slow_vectors(texts)
    got = {r.id: r for r in retrieval.max_similarity(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")).collect()}
    assert sorted(got) == [i for i in range(len(texts)) if i % 2]
    for i, r in got.items():
        sims = [(round(cosine(v[i], v[j]), 9), -j) for j in range(0, len(texts), 2)]
        top, j = max(sims)
        assert abs(r.max_sim - top) < 1e-8 and r.best == (-j if top > 0 else None)


def test_pairs_above_a_threshold_equal_all_pairs(spark, texts):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, m int")
    v = slow_vectors(texts)
    made = retrieval.vectors(rows, ["id"])
    for least in (0.3, 0.8, 0.95):
        got = {(r.a, r.b): r.s for r in retrieval.pairs_above(made, made, least).collect()}
        want = {(i, j): cosine(v[i], v[j]) for i in range(len(texts)) for j in range(len(texts)) if i != j}
        want = {k: s for k, s in want.items() if s >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_few_pairs_meet(spark):
    """Rows that meet, against the join of whole posting lists: documents for the maximum of each benchmark item, whose best
    cosine is 0.2 on average, and documents among themselves for near-duplicates."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").select(F.lit(0).alias("side"), F.col("doc_id").alias("id"), "text", F.lit(1).alias("m"))
    items = spark.read.parquet(f"{base}/benchmark.parquet").select(F.lit(1).alias("side"), F.col("item_id").alias("id"), "text", F.lit(1).alias("m"))
    rows = retrieval.vectors(docs.unionByName(items), ["side", "id"])
    near, postings = retrieval._bounded(rows.filter("side = 0"), rows.filter("side = 1"))
    posts = postings.groupBy("g", "size").agg(F.count("*").alias("n"))
    of = lambda d: d.join(posts, ["g", "size"]).agg(F.sum("n")).first()[0]
    assert of(near.filter("met")) * 2 <= of(near)
    made = rows.filter("side = 0").drop("side")
    meeting = lambda d: d.groupBy("g").agg((F.count("*") * F.count("*")).alias("n")).agg(F.sum("n")).first()[0]
    assert meeting(retrieval.prefixes(made, 0.95)) * 10 <= meeting(made)


def test_no_texts(spark):
    rows = spark.createDataFrame([(1, "abc def"), (2, None)], "id long, text string")
    assert [tuple(r) for r in retrieval.max_similarity(rows.limit(0), rows).orderBy("id").collect()] == [(1, None, 0.0), (2, None, 0.0)]
    assert retrieval.max_similarity(rows, rows.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.6, 0.9, 0.95])
def test_near_texts_are_those_of_a_high_maximum(spark, texts, least):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    train, other = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    got = [r.id for r in retrieval.near(train, other, least).collect()]
    want = [r.id for r in retrieval.max_similarity(train, other).filter(F.col("max_sim") >= least).collect()]
    assert want and sorted(got) == sorted(want)


def test_the_report_needs_no_best_cosines(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "max_similarity", None)
    got = OPERATOR_QUERIES["assembled"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.n for r in got)


def test_blocks_do_not_matter(spark, texts, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sides = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    whole = {r.id: (r.best, round(r.max_sim, 9)) for r in retrieval.max_similarity(*sides).collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 2000)
    found = retrieval.max_similarity(*sides)
    assert {r.id: (r.best, round(r.max_sim, 9)) for r in found.collect()} == whole
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # pairs are compared in tasks and never shuffled


ODD = ["a", "aaaa aaaa aaaaa", "x\x0by\x1cz", "\x00 \x00\x00 ab\x00 ab", "é𝄞x É𝄞X ß İ", "　b c\u0085d", "", " \t\r\n\f", "ab " * 3000, "语言模型 语言", "x" * 300]


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_counts_of_a_block_equal_exploded_ngrams(spark, monkeypatch, cells):
    monkeypatch.setattr(retrieval, "_CELLS", cells)
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    want = Counter((r.id, r.g) for r in rows.select("id", F.explode(retrieval.grams("text")).alias("g")).collect())
    low = [r.text.encode() for r in rows.orderBy("id").select(F.lower("text").alias("text")).collect()]
    counts = retrieval._Counts(low)

    def text(a, b):
        rest = [x - 1 for x in (b >> 21, b & (1 << 21) - 1) if x]
        return "".join(map(chr, [a >> 42, a >> 21 & (1 << 21) - 1, a & (1 << 21) - 1, *rest]))

    names = [text(a, b) for a, b in zip(counts.a.tolist(), counts.b.tolist(), strict=True)]
    got = {(t, names[g]): tf for part in counts.cells() for t, g, tf in zip(*(x.tolist() for x in part), strict=True)}
    assert got == want and len(set(names)) == len(names)
    counts.times = counts.times << 45  # too large to be sorted as one number with the text and n-gram
    assert sum(int(tf.sum()) >> 45 for _, _, tf in counts.cells()) == sum(want.values())


def test_ngrams_of_training_texts_are_never_rows(spark, monkeypatch):
    """All that is written and grouped is texts and, for each block, a row for each n-gram; not one for each text and n-gram."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    made = [" ".join(draw.sample(words, 25)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(made)), "id long, text string")
    cells = rows.select("id", F.explode(retrieval.grams("text")).alias("g")).distinct().count()
    written = []
    real = retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda d: written.append(real(d)) or written[-1])
    sides = rows.filter("id >= 10"), rows.filter("id < 10")
    got = {r.id: (r.best, r.max_sim) for r in retrieval.max_similarity(*sides).collect()}
    v = slow_vectors(made)
    for i, (best, s) in got.items():
        top, j = max((round(cosine(v[i], v[j]), 9), -j) for j in range(10, 400))
        assert abs(s - top) < 1e-8 and best == -j
    assert len(got) == 10 and sum(d.count() for d in written) * 10 <= cells


def test_blocks_of_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \t")], "id long, text string")
    assert [tuple(r) for r in retrieval.max_similarity(rows, rows).orderBy("id").collect()] == [(1, None, 0.0), (2, None, 0.0), (3, None, 0.0)]


@pytest.mark.parametrize("block", [8000, 1 << 22])
def test_near_texts_need_no_rows_of_ngrams(spark, texts, monkeypatch, block):
    """Ids of both sides overlap, texts are odd or empty, near copies come in groups, and the best partner by rare n-grams isn't always near."""
    long = [f"the quick brown fox {i % 7} jumps over lazy dogs and runs along the river bank at dawn number {i % 5}" for i in range(60)]
    sides = [[(i, t) for i, t in enumerate([*texts, *ODD, *long, None])], [(i, t) for i, t in enumerate([*ODD, *(x.replace("river", "stream") for x in long[::2]), *texts[::3], "", None])]]
    sides = [spark.createDataFrame(x, "id long, text string") for x in sides]
    want = {least: sorted(r.id for r in retrieval.max_similarity(*sides).filter(F.col("max_sim") >= least).collect()) for least in (0.5, 0.95)}
    monkeypatch.setattr(retrieval, "vectors", None)
    monkeypatch.setattr(retrieval, "pairs_above", None)
    monkeypatch.setattr(retrieval, "BLOCK", block)
    for least, ids in want.items():
        assert ids and sorted(r.id for r in retrieval.near(*sides, least).collect()) == ids

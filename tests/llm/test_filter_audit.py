"""The audit of filters against a document-by-document replay of every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from threadlens.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, mask string, part string, n string, good string"


def slow(rows, labels):
    """Every document through every order, by the definitions."""
    texts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    out = {}
    for i, t, s in rows:
        t, s = t or "", s or ""
        words = re.findall(fa.WORD, t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j < i for j in texts[t]),
        }
        good = i is not None and any(q == 1 for d, q, _ in labels if d == i)
        toxic = i is not None and any(x == 1 for d, _, x in labels if d == i)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                r = out.setdefault((s, order, step), [0] * 6)
                if fails[letter]:
                    r[1 if not gone else 2] += 1
                    r[3] += sum(fails.values()) == 1
                    if not gone:
                        r[4] += good
                        r[5] += toxic
                    gone = True
                r[0] += not gone
    total = defaultdict(int)
    for (s, order, step), r in out.items():
        total[s, order[step - 1]] += r[1]
    return sorted((*k, *r, total[k[0], k[1][k[2] - 1]]) for k, r in out.items())


def rows_of(df):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert set(names) == set(df.columns)
    return sorted(map(tuple, df.select(names).collect()))


def test_equals_a_replay_of_every_order(spark):
    draw = random.Random(3)
    kinds = ["short", " ".join(f"w{i}" for i in range(210)), "same word " * 120, "CAPITAL Letters " * 3, "cost $5 | 10%", "", None]
    rows = [(i, draw.choice(kinds), draw.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(7, kinds[1], "a"), (7, kinds[1], "b"), (7, kinds[1], "b"), (None, kinds[1], "a"), (None, kinds[1], None), (-5, kinds[2], "c"), (100, "𝕏 𝕏X", "d")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 60, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*x, "x", "x") for x in labels], "doc_id long, quality int, toxic int, part string, n string")
    assert rows_of(fa.audit(fa.cells(docs, marks))) == slow(rows, labels)
    assert rows_of(fa.audit(fa.cells(docs.repartition(5), marks.repartition(3)))) == slow(rows, labels)


def test_empty_tables_and_hot_copies(spark):
    none = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.cells(none, marks)).count() == 0
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    found = fa.cells(copies, marks).collect()
    assert sorted((r["mask"], r["n"]) for r in found) == [(1, 1), (17, 4999)]
    first = fa.audit(fa.cells(copies, marks)).filter("filter_order = 'EABCD' and step <= 2").orderBy("step").collect()
    assert [(r["removed"], r["kept"], r["redundant"]) for r in first] == [(4999, 1, 0), (1, 0, 4999)]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "Word other " * 200_000, "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [(r["mask"], r["n"], r["good"], r["toxic"]) for r in fa.cells(docs, marks).collect()] == [(6, 1, 1, 1)]


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 4, 1, 0), ("p", 3, 2, 2, 1)], "part string, mask int, n long, good long, toxic long")
    found = fa.audit(cells, "XY").orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in found] == [
        ("XY", 1, 4, 2, 0, 0, 2), ("XY", 2, 4, 0, 2, 0, 2), ("YX", 1, 4, 2, 0, 0, 2), ("YX", 2, 4, 0, 2, 0, 2)]

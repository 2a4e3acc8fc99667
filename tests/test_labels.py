"""Strict joins, codebook rows, tallies, candidates and draws."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import labels


def test_strict_join(spark):
    a, b = spark.range(3), spark.range(3).withColumn("x", F.col("id") * 2)
    assert labels.joined_all(a, b, "id").count() == 3
    with pytest.raises(ValueError, match="no partner"):
        labels.joined_all(spark.range(4), b, "id")


def test_codebook_rows(spark):
    got = labels.codebook_rows(spark, {"i": ["1", "2"]}, {"s": ["3"]}).collect()
    assert [tuple(r)[:3] for r in got] == [("1", "", "i"), ("2", "", "i"), ("3", "s", "")]
    assert labels.codebook_rows(spark, {}, {}).count() == 0


def test_tallies(spark):
    rows = [("s", "i", "j;k", "t", "e"), ("s", "i", None, None, ""), ("o", "", "j", "", "e")]
    got = {tuple(r) for r in labels.tallies(spark.createDataFrame(rows, "state string, intent string, secondary string, subtype string, event string")).collect()}
    assert got == {("several", "", "", 1), ("subtype", "i", "t", 1), ("subtype", "i", "", 1), ("event", "e", "i", 1), ("event", "e", "o", 1), ("tied", "i", "", 1)}


def test_candidates(spark):
    rows = spark.createDataFrame([(1, 5, ""), (2, 0, None), (3, 9, " "), (4, 0, "look")], "id long, v long, note string")
    got = labels.candidates(rows, {"big": F.col("v") > 4, "huge": F.col("v") > 8}, "note", "id").collect()
    assert [(r.id, r.flags) for r in got] == [(4, []), (3, ["big", "huge"]), (1, ["big"])]


def test_draws(spark):
    rows = spark.range(100)
    got = labels.bucket_sample(rows, {"even": F.col("id") % 2 == 0, "all": F.lit(True)}, 5, "id").collect()
    assert len(got) == len({r.id for r in got}) == 10 and all((r.id % 2 == 0) == (r.bucket == "even") for r in got)
    assert sorted(got) == sorted(labels.bucket_sample(rows.repartition(7), {"even": F.col("id") % 2 == 0, "all": F.lit(True)}, 5, "id").collect())
    m = spark.createDataFrame([(t, i) for t in range(6) for i in range(t)], "thread long, i long")
    sample = labels.thread_sample(m, 2, 2, 4)
    assert sample.select("thread").distinct().count() == 2 and sample.filter("thread < 2 or thread > 4").count() == 0


def test_behaviours_of_a_sample(spark):
    context = [("customer", "it fails"), ("brand", "which console?")]
    rows = spark.createDataFrame(
        [(1, ["anger"], "my PASSWORD", 9, False, []), (2, ["prior_contact"], "dead disc drive", 3, True, context), (3, [], "hm", 1, False, context)],
        "i long, s array<string>, t string, n int, f boolean, c array<struct<role:string,text:string>>",
    )
    found = labels.behaviours(*(F.col(x) for x in "stnfc"))
    got = {r.i: {k for k in found if r[k]} for r in rows.select("i", *(c.alias(k) for k, c in found.items())).collect()}
    assert got == {1: {"strong_anger", "account_specific"}, 2: {"repeat_contact", "after_clarification", "repair_replacement"}, 3: {"vague_low_confidence"}}


def test_development_set_and_ratings(spark):
    sheet = spark.createDataFrame([("d1", " r1 ", "yes", "Yes", "no", "maybe")], "dev_id string, record_id string, escalate string, cue_a string, cue_b string, cue_c string")
    key = spark.createDataFrame([("d1", "random")], "dev_id string, slice string")
    pool = spark.createDataFrame([("r1", "other", "call our chat team")], "record_id string, reply_type string, brand_reply string")
    r = labels.development_set(sheet, key, pool, ["a", "b", "c"]).first()
    assert (r.slice, r.cue_a, r.cue_b, r.cue_c, r.label_escalates, r.handed_off) == ("random", True, False, None, True, True)
    with pytest.raises(ValueError):
        labels.development_set(sheet, key, pool.limit(0), ["a"])
    human = spark.createDataFrame([(1, "4", ""), (2, "5", "3")], "id long, tone string, facts string")
    judge = spark.createDataFrame([(1, "3", "2"), (2, "5", "1"), (3, "1", "1")], "id long, tone string, facts string")
    assert sorted(map(tuple, labels.rated_pairs(human, judge, ["tone", "facts"], "id").collect())) == [("facts", 3, 1), ("tone", 4, 3), ("tone", 5, 5)]
    calls = spark.createDataFrame([(None, 100, 1.0, 4), (None, 200, 3.0, 5), ("rate limit hit, try again in 5s", None, None, None)], "error string, tokens int, latency_s double, tone int")
    assert tuple(labels.judged_summary(calls, ["tone"]).first()) == (2, 1, 1, 2.0, 3.0, 150.0, 4.5)


def test_training_rows_stay_apart_from_golden_ones(spark):
    corpus = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "record_id string, n int")
    apart = spark.createDataFrame([("c",), (None,)], "record_id string")
    assert labels.require_apart(corpus, apart).count() == 4
    with pytest.raises(ValueError, match="'b'"):
        labels.require_apart(corpus, apart.union(corpus.select("record_id").filter("n = 3")))

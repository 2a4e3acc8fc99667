"""Ancestors by doubling against walking up, on deep and broken threads and on lazily read views."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import context, threads
from threadlens.plans.dialect import SPARK
from threadlens.plans.shared_sql import lines
from threadlens.sources.tables import cut, register

SCHEMA = "tweet_id long, parent long, created long"


def walk(rows, i, most, minutes):
    at = {r[0]: r for r in rows}
    start, up, found = at[i][2], at[i][1], []
    while up in at and len(found) < most and start - at[up][2] <= minutes:
        found.append(up)
        up = at[up][1]
    return found, up in at and len(found) < most


@pytest.mark.parametrize("most, minutes", [(50, 10_080), (3, 10_080), (50, 40), (1, 5), (64, 10**9)])
def test_chains_equal_walking_up(spark, most, minutes):
    draw = random.Random(8)
    rows = [(1, None, 0)] + [(i, draw.choice([i - 1, i - 1, i - 1, max(1, i - 7), None, 5000]), draw.randrange(8) + 3 * i) for i in range(2, 300)]
    rows += [(1000 + i, 1000 + i - 1 if i else None, i) for i in range(140)] + [(2000 + i, 1070, 500) for i in range(50)]
    messages = spark.createDataFrame(rows, SCHEMA)
    records = messages.filter("tweet_id % 3 <> 1").select((F.col("tweet_id") * 10).alias("record_id"), F.col("tweet_id").alias("first_id"))
    got = {}
    for r in context.chains(messages, records, most, minutes).orderBy("record_id", "step").collect():
        found = got.setdefault(r.record_id // 10, ([], r.stale))
        assert found[1] == r.stale and r.step == len(found[0]) + (r.tweet_id is not None)
        if r.tweet_id is not None:
            found[0].append(r.tweet_id)
    assert got == {i: walk(rows, i, most, minutes) for i, _, _ in rows if i % 3 != 1}


def test_no_messages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert context.chains(none, none.select(F.col("tweet_id").alias("record_id"), F.col("tweet_id").alias("first_id"))).count() == 0


def test_cut_tables_of_computed_columns_can_be_joined(spark):
    """Levels filtered by a computed column, cut, united and joined again, and read in full."""
    register(spark, "/root/testdata/sf0.001", ["conversations"])
    rows = spark.sql(f"WITH {lines(SPARK)} SELECT * FROM l")
    parts = threads.anchored(rows)
    for joined in (parts.join(rows.select("tweet_id", "text"), "tweet_id"), threads.merged_replies(rows, parts), threads.exchanges(rows, parts)):
        assert len(joined.collect()) > 0
    near = cut(rows.filter("created - conv_id * 60 < 20"))
    assert len(near.unionByName(near).join(rows.select("tweet_id", F.col("created").alias("at")), "tweet_id").filter("at - created = 0").collect()) == 2 * near.count()
    assert len(threads.thread_roots(rows).join(rows, "tweet_id").collect()) == rows.count()
    records = rows.filter("inbound").select(F.col("tweet_id").alias("record_id"), F.col("tweet_id").alias("first_id"))
    assert len(context.chains(rows, records).join(rows.select("tweet_id", "text"), "tweet_id").collect()) > 0

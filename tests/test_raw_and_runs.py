"""Raw files read by ranges, runs of model calls that stop, and intervals over numbers with many values."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import model_calls, scores
from threadlens.sources import stores, tables


def raw_file(path, seed, n=80):
    rng = random.Random(seed)
    pieces = ["word", " ", "\n", '"', ",", "\n\n", "é", '""', "x, y"]
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerow("tweet_id author_id inbound created_at text response_tweet_id in_response_to_tweet_id".split())
        for i in range(n):
            text = "t" + "".join(rng.choices(pieces, k=rng.randrange(12))) + "t" if i % 9 else ""
            out.writerow([seed * 1000 + i, "a", "True", "Tue Oct 31 22:10:47 +0000 2017", text, "", i or ""])


@pytest.mark.parametrize("size", [200, 900, 1 << 20])
def test_raw_files_read_by_ranges_equal_the_whole(spark, tmp_path, size):
    for seed in (1, 2):
        raw_file(tmp_path / f"{seed}.csv", seed)
    whole = spark.read.csv(str(tmp_path), schema=tables.RAW_SCHEMA, header=True, multiLine=True, escape='"')
    want = {r.tweet_id: (r.text or "", r.in_response_to_tweet_id) for r in whole.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        found = tables.load_raw(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 160 and {r.tweet_id: (r.text, r.in_response_to_tweet_id) for r in found} == want
    assert all(r.inbound and r.lower == r.text.lower() and str(r.created_at) == "2017-10-31 22:10:47" for r in found)
    assert tasks > 2 or size > 900


def test_raw_file_without_rows(spark, tmp_path):
    raw_file(tmp_path / "1.csv", 1, n=0)
    assert tables.load_raw(spark, str(tmp_path)).count() == 0


def test_stopped_run_keeps_its_rounds(spark, tmp_path):
    store = str(tmp_path / "store")
    asked = spark.range(40).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("prompt "), "id").alias("prompt"))

    def stops(prompt):
        if prompt == "prompt 17":
            raise RuntimeError("quota")
        return prompt if prompt != "prompt 3" else None

    with pytest.raises(Exception, match="quota"):
        model_calls.complete(asked, store, stops, rounds=40)
    kept = {r.key for r in stores.responses(spark, store).collect()}
    assert 0 < len(kept) < 40 and "k17" not in kept

    def goes_on(prompt):
        if "k" + prompt[7:] in kept:
            raise AssertionError("asked again")
        return prompt if prompt != "prompt 3" else None

    found = {r.key: r.value for r in model_calls.complete(asked, store, goes_on, rounds=3).collect()}
    assert found == {f"k{i}": None if i == 3 else f"prompt {i}" for i in range(40)}


def test_interval_of_a_mean_of_many_values(spark):
    values = np.random.default_rng(1).exponential(100, 400).round(3)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = scores.bootstrap_mean(rows, "v", 4000).first()
    drawn = values[np.random.default_rng(0).integers(0, 400, (10_000, 400))].mean(1)
    low, high = np.percentile(drawn, [2.5, 97.5])
    width = high - low
    assert got.n == 400 and got.value == pytest.approx(values.mean(), abs=1e-5)
    assert abs(got.lo - low) < 0.06 * width and abs(got.hi - high) < 0.06 * width
    again = scores.bootstrap_mean(rows.repartition(7), "v", 4000).first()
    assert again.lo == pytest.approx(got.lo, abs=1e-5) and again.hi == pytest.approx(got.hi, abs=1e-5)
    none = scores.bootstrap_mean(rows.filter("v < 0"), "v", 100).first()
    assert tuple(none) == (None, None, None, 0)

"""URL filters by a cascade of Bloom filters: exact membership of listed keys without a join.

A rule is a host and a beginning of a path, in one string (``example.org/es/``). It fits the host and its subdomains, where
the path starts with the rule's. A URL's keys are all such strings that could be rules for it: each end of its host at a
label, with each beginning of its path whose length some rule has. These keys of all URLs are the universe.

Level 0 is a Bloom filter of the listed keys. The keys of the universe that pass it though they aren't listed are its false
positives; level 1 is a filter of those; the listed keys that pass level 1 make level 2, and so on until a level has none. A key
of the universe is listed exactly if the first level that rejects it is an odd one (or none rejects it and the number of
levels is odd). The first level's rate of false positives is the listed keys' share of the universe over the root of 2, the
others' is a half, so the whole takes few bits for each listed key and depends little on the universe.

One pass over the corpus counts the universe, one finds the false positives of level 0, one judges; the other levels are made
from listed keys and false positives alone. A filter is an array of 64-bit words, made by a distributed bit-or and broadcast.
Its size is bounded: at most ``MOST_BITS`` bits a level, or building raises. Nothing of the corpus goes to the driver but
counts and these words. Keys are hashed in the JVM; batches of hashes are tested with NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import fresh, own_columns, table, written

#: Bits of a level at most (32 MB), which bounds what is broadcast; about 10 million listed keys in a universe of 1,000 times as many.
MOST_BITS = 1 << 28
MOST_LEVELS = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of a level's own, from those of the keys."""
    h = hashes.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: the usual 64-bit finaliser
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


@dataclass
class Level:
    """A Bloom filter: bit p is bit p % 64 of word p // 64. number: its place in the cascade."""

    number: int
    bits: int
    probes: int
    words: object = None  # a broadcast np.ndarray

    def places(self, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        """The bit of each key by each probe."""
        a, b = _mixed(one, self.number), _mixed(two, self.number) | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def passed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        words, found = self.words.value, np.ones(len(one), bool)
        for p in self.places(one, two):
            found &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found


def _members(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which keys are listed: a key is decided by the first level that rejects it."""
    found, open_ = np.full(len(one), len(levels) % 2 == 1), np.arange(len(one))
    for level in levels:
        passed = level.passed(one[open_], two[open_])
        found[open_[~passed]] = level.number % 2 == 1
        open_ = open_[passed]
    return found


def build_level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """A Bloom filter of ``count`` keys (column key) with about this rate of false positives."""
    bits = max(64, 64 * math.ceil(count * math.log2(1 / rate) / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"level {number} would take {bits} bits, more than {MOST_BITS}: split the listed keys")
    level = Level(number, bits, max(1, round(math.log2(1 / rate))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.concatenate(list(level.places(*(c.to_numpy() for c in batch.columns)))))
            value = np.uint64(1) << (places & np.uint64(63))
            word, at = np.unique(places >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(value, at) if len(at) else value
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.astype(np.int64))], ["w", "v"])

    # at most MOST_BITS / 64 rows
    found = keys.select(*_hashes(F.col("key"))).mapInArrow(each, "w int, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("w").to_numpy()] = found.column("v").to_numpy().astype(np.uint64)
    level.words = keys.sparkSession.sparkContext.broadcast(words)
    return level


def passes(key: Column, level: Level) -> Column:
    """Whether a level has all bits of a key."""

    @F.arrow_udf("boolean")
    def test(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(level.passed(one.to_numpy(), two.to_numpy()))

    return test(*_hashes(key))


def listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: exact for those, and for no others."""

    @F.arrow_udf("boolean")
    def test(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(_members(levels, one.to_numpy(), two.to_numpy()))

    return test(*_hashes(key))


def first_listed(keys: Column, levels: list[Level]) -> Column:
    """The first of an array of keys of the universe that is listed, or null."""

    @F.arrow_udf("int")
    def place(one: pa.Array, two: pa.Array) -> pa.Array:
        sizes = np.array(one.value_lengths().fill_null(0))
        found = _members(levels, one.flatten().to_numpy(), two.flatten().to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)[found]
        at = (np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[found]
        out, firsts = np.full(len(sizes), -1, np.int32), np.unique(row, return_index=True)
        out[firsts[0]] = at[firsts[1]]
        return pa.array(out, mask=out < 0)

    return F.get(keys, place(F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1])))


def build(keys: DataFrame, universe: DataFrame) -> list[Level]:
    """The levels for listed keys in a universe, both with a column key; repeats and nulls don't matter, listed keys outside of
    the universe are allowed. No listed keys make no level."""
    keys = written(keys.select("key").filter("key is not null").distinct(), "listed")
    universe = universe.select("key").filter("key is not null")
    n = keys.count()
    if not n:
        return []
    size = max(universe.agg(F.approx_count_distinct("key", 0.02)).first()[0], 1)
    levels = [build_level(keys, 0, n, min(0.5, n / (size * math.sqrt(2))))]
    # what must be kept out, and what must be let in, of those that passed all levels so far
    out = universe.filter(passes(F.col("key"), levels[0])).distinct().join(keys, "key", "left_anti")
    out, kept = written(out, "passed-0"), keys
    while (left := out.count()) and len(levels) < MOST_LEVELS:
        levels.append(build_level(out, len(levels), left, 0.5))
        out, kept = written(kept.filter(passes(F.col("key"), levels[-1])), f"passed-{len(levels)}"), out
    if left:
        raise RuntimeError(f"{left} keys passed {MOST_LEVELS} levels")
    return levels


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _split(rule: Column) -> tuple[Column, Column]:
    at = F.instr(rule, "/")
    whole = F.when(at > 0, at - 1).otherwise(F.length(rule))
    return F.substring(rule, F.lit(1), whole), F.substring(rule, whole + 1, F.length(rule))


def url_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The keys of a URL, longest first, of equally long ones that of the longer host first: the last ``labels`` ends of its host
    with the beginnings of its path of these lengths. An empty host has none."""
    parts = F.split(host, r"\.")
    low = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    # no longer end than the rules' hosts have, but an end is the host itself only if it has no more labels
    ends = F.transform(F.sequence(low, F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    heads = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.substring(path, F.lit(1), F.lit(n)).alias("s")) for n in lengths)), lambda h: F.length(h["s"]) == h["n"])
    pairs = F.flatten(F.transform(ends, lambda e: F.transform(heads, lambda h: F.struct(
        (-F.length(e) - h["n"]).alias("short"), (-F.length(e)).alias("near"), F.concat(e, h["s"]).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(pairs), lambda p: p["key"]))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The columns of pages (url) with host, path, rule and verdict.

    rules: rule, verdict (allow or block). Of the rules that fit a URL the longest wins, of equally long ones that of the longer
    host; of a rule that is listed with both verdicts, block. Hosts of rules are compared with A-Z lower-cased, and rule is given
    so. A URL that no rule fits (null, without ``://``, an empty host) has a null rule and the ``default``: cascades tell
    exactly that it is not listed. Null rules are ignored; without rules, or pages, nothing fits. New columns whose names pages
    has already get underscores behind theirs.

    Two cascades: all rules among the keys of all URLs, and the blocking rules among all rules.
    """
    into = [fresh(c, pages) for c in ("host", "path", "rule", "verdict")]
    host_, path_ = _split(F.col("rule"))
    named = rules.filter("rule is not null").select(F.translate(host_, _UPPER, _LOWER).alias("host"), path_.alias("path"), "verdict")
    named = written(named.select(F.concat("host", "path").alias("key"), "host", "path", (F.col("verdict") == "block").alias("block")), "rules")
    shape = named.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    rows = pages.select("*", host(F.col("url")).alias(into[0]), path(F.col("url")).alias(into[1]))
    if shape["labels"] is None:
        return rows.select("*", F.lit(None).cast("string").alias(into[2]), F.lit(default).alias(into[3]))
    keys = url_keys(F.col(into[0]), F.col(into[1]), shape["labels"], sorted(shape["lengths"]))
    levels = build(named, rows.select(F.explode(keys).alias("key")))
    blocking = build(named.filter("block"), named)
    at = fresh("keys", rows)
    rows = rows.withColumn(at, keys)
    rows = rows.withColumn(into[2], first_listed(F.col(at), levels))
    blocks = F.when(listed(F.col(into[2]), blocking), "block").otherwise("allow")
    return rows.select(*own_columns(pages), *into[:3], F.when(F.col(into[2]).isNull(), default).otherwise(blocks).alias(into[3]))


#: The rules of the query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op12_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "rule string, verdict string")).select("page_id", "host", "path", "rule", "verdict")

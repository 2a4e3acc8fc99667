"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, their beginnings, runs of punctuation, and pairs of these): the target model counts in
how many labelled good documents an n-gram is, the raw model in how many of all documents. A document's log importance is the sum of its
distinct n-grams' log ratios of target to raw. A ratio is taken relative to that of ordinary n-grams (the weighted median of all,
which is above 1 as raw text holds n-grams that good text doesn't), is drawn towards 0 by ``shrink`` standard errors (more
for pairs, of which a text has many rare ones), as counts of a bucket are uncertain, and by ``margin`` (0.5: n-grams less than 1.6 times as frequent in raw text as expected
say nothing), and counts only where it speaks against the target; so importance doesn't follow a document's length, and small
differences don't add up in long ones.

Documents are then sampled without replacement by Gumbel top-k: log importance over ``temperature`` plus Gumbel noise drawn
from a hash of the doc_id, of which the k largest are accepted. k is the number of documents whose log importance
reaches a threshold calibrated on labelled documents that the target model didn't see.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import blocks, fresh, table, text_bytes, written

PIECES = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCKS = 32
_COUNTS = ["block", "raw", "seen", "target"]
_SCHEMA = "block int, raw binary, seen binary, target binary"


@dataclass(frozen=True)
class Settings:
    """labelled: most labelled rows used, by a hash of their id. kept: share of good calibration documents that the
    threshold must keep. least: evidence against a document, in nats, that rejects it at least."""

    bits: int = 18
    labelled: int = 100_000
    shrink: float = 2.0
    shrink_pairs: float = 5.0
    margin: float = 0.5
    prior: float = 1.0
    temperature: float = 0.1
    kept: float = 0.997
    least: float = 0.7
    seed: int = 42


def _grams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's n-grams, with the text's number. Words (with their beginnings, and one bucket
    for texts in which over a quarter of the words repeat the word before) and pairs have half the buckets each."""
    crc, half, found, sizes = zlib.crc32, np.uint64(64 - bits), [], []
    for text in texts:  # short sorts, a text each
        words = PIECES.findall(text.lower())
        kinds = set(words)
        h = np.fromiter(map(crc, words), np.uint64, len(words))
        starts = np.fromiter((crc(w[:4], 1) for w in kinds), np.uint64, len(kinds))
        two = ((h[:-1] * _ODD2 + h[1:]) * _ODD) >> half
        one = np.maximum((np.concatenate([np.fromiter(map(crc, kinds), np.uint64, len(kinds)), starts]) * _ODD) >> half, np.uint64(1))
        if 4 * np.count_nonzero(h[:-1] == h[1:]) > len(words):
            one = np.append(one, np.uint64(0))
        both = np.concatenate([one, two + np.uint64(1 << bits)])
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        found.append(both)
        sizes.append(len(both))
    grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return grams.astype(np.int64), np.repeat(np.arange(len(texts)), sizes)


def _count(labels, bits: int):
    """doc_id, text -> partial raw and target counts of a task, in blocks of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = labels.value
        raw, seen, target = (np.zeros(2 << bits, np.int64) for _ in range(3))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in blocks(map(len, texts), 4_000_000):
                grams, owner = _grams(texts[a:b], bits)
                raw += np.bincount(grams, minlength=2 << bits)
                mine = np.array([good.get(i, (False, True)) for i in ids[a:b]], bool)
                if (~mine[:, 1]).any():
                    seen += np.bincount(grams[~mine[owner, 1]], minlength=2 << bits)
                    target += np.bincount(grams[~mine[owner, 1] & mine[owner, 0]], minlength=2 << bits)
        cols = [
            pa.array(range(_BLOCKS), pa.int32()),
            *(pa.array([x.astype("<u4").tobytes() for x in np.split(n, _BLOCKS)], pa.binary()) for n in (raw, seen, target)),
        ]
        yield pa.RecordBatch.from_arrays(cols, _COUNTS)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task's blocks -> their sums as 64-bit numbers."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = [np.frombuffer(p, "<u4").astype(np.int64) for p in parts]
            sums[block] = [x + y for x, y in zip(sums[block], got, strict=True)] if block in sums else got
    cols = [
        pa.array(list(sums), pa.int32()),
        *(pa.array([s[i].astype("<i8").tobytes() for s in sums.values()], pa.binary()) for i in (0, 1, 2)),
    ]
    yield pa.RecordBatch.from_arrays(cols, _COUNTS)


def log_ratios(raw: np.ndarray, seen: np.ndarray, target: np.ndarray, prior: float, shrink: float, margin: float) -> np.ndarray:
    """A number of 0 or less for each bucket: how far the target model falls short of the raw model, and of the same
    model of all labelled documents, whichever is less. The second comparison keeps groups of copies, which the labelled
    sample may hold more or fewer of than the corpus, from speaking against anything."""
    if not target.sum():
        return np.zeros(len(raw))
    out = np.full(len(raw), -np.inf)
    for other in (raw, seen):
        ratio = np.log((target + prior) / (target.sum() + prior * len(raw)))
        ratio -= np.log((other + prior) / (other.sum() + prior * len(raw)))
        order = np.argsort(ratio)
        weight = np.cumsum(target[order])
        ratio -= ratio[order][np.searchsorted(weight, weight[-1] / 2)]
        error = np.sqrt(1 / (target + prior) + 1 / (other + prior))
        out = np.maximum(out, ratio + shrink * error + margin)
    return np.minimum(0, out)


def _score(shared, bits: int, columns: int, names: list[str]):
    """All columns (doc_id first, text second) -> them, the log importance, and the label of calibration rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, good = shared.value
        for batch in batches:
            texts, ids = text_bytes(batch.column(1)), batch.column(0).to_pylist()
            scores = np.zeros(len(texts))
            for a, b in blocks(map(len, texts), 4_000_000):
                grams, owner = _grams(texts[a:b], bits)
                scores[a:b] = np.bincount(owner, ratios[grams], minlength=b - a)
            label = [g[0] if (g := good.get(i)) and g[1] else None for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(scores), pa.array(label, pa.bool_())], names)

    return run


def threshold(scores: np.ndarray, good: np.ndarray, kept: float, least: float) -> float:
    """The log importance to reach: as high as the share ``kept`` of good rows allows, at most midway to the best of the
    bad rows below, and below -least. Without rows of both kinds, everything is accepted."""
    if not good.any() or good.all():
        return -np.inf
    edge = np.quantile(scores[good], 1 - kept, method="lower")
    below = scores[~good & (scores < edge)]
    return min(float((edge + below.max()) / 2) if len(below) else float(edge), -least)


@dataclass
class Model:
    """ratios: log ratios. labels: those used (id -> good, for calibration). threshold: of acceptance. cut: the least key
    of the top k. scores: the documents' kept columns, then those called ``names``: log importance, label, key."""

    settings: Settings
    ratios: np.ndarray
    labels: dict
    threshold: float
    cut: float
    scores: DataFrame
    names: tuple[str, str, str]


def _key(s: Settings, log_importance: str) -> Column:
    """Log importance over temperature plus Gumbel noise from the doc_id."""
    u = (F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.col(log_importance) / F.lit(s.temperature) - F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 1024, few: int = 4096) -> float:
    """The k-th largest key, by counting keys in ever smaller ranges; only the last, small range comes to the driver."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n == 0 or k <= 0:
        return np.inf
    if k >= n:
        return -np.inf
    part, left = df.select(F.col(key).alias("k")), k
    for _ in range(12):
        if n <= few or low == high:
            break
        width = (high - low) / bins
        place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("k") - F.lit(low)) / F.lit(width))))
        counts = sorted(part.groupBy(place.cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect(), reverse=True)
        for r in counts:
            if left <= r.n:
                low, high, n = r.lo, r.hi, r.n
                break
            left -= r.n
        part = part.filter(F.col("k").between(F.lit(low), F.lit(high)))
    if low == high:
        return low
    return part.orderBy(F.desc("k")).limit(left).agg(F.min("k")).first()[0]


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> Model:
    """Fit on ``documents`` (doc_id, text) and ``labels`` (doc_id, good boolean), and score the documents, once. keep: the
    columns that the scores carry, doc_id among them (default: all).

    Of labels at most ``settings.labelled`` are used, a quarter of them for the threshold; n-grams of the raw model are those
    of all documents. Ids that are labelled more than once take one of the labels, bad before good. Null ids and labels
    are not used. Without good labels every document is accepted. Null and empty texts have no n-grams and a log
    importance of 0; repeated rows count and are scored each. Columns of any name pass through unchanged.
    """
    s, spark = settings, documents.sparkSession
    rows = labels.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = rows.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.labelled)
    rows = rows.select("doc_id", "good", (F.pmod(F.xxhash64(F.lit(s.seed + 1), "doc_id"), F.lit(4)) == 0).alias("held"))
    known = {r.doc_id: (r.good, r.held) for r in rows.collect()}
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    partial = texts.mapInArrow(_count(spark.sparkContext.broadcast(known), s.bits), _SCHEMA)
    counts = np.zeros((3, 2 << s.bits), np.int64)
    size = (2 << s.bits) // _BLOCKS
    for r in partial.repartition(_BLOCKS, "block").mapInArrow(_sum, _SCHEMA).toLocalIterator():  # _BLOCKS rows
        for n, part in zip(counts, (r.raw, r.seen, r.target), strict=True):
            n[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(part), "<i8")
    words, pairs = np.split(counts, 2, axis=1)
    ratios = [log_ratios(*n, s.prior, z, s.margin) for n, z in ((words, s.shrink), (pairs, s.shrink_pairs))]
    ratios = np.concatenate(ratios)
    names = tuple(fresh(n, documents) for n in ("log_importance", "label", "key"))
    model = Model(s, ratios, known, -np.inf, -np.inf, documents, names)
    log, label, key = names
    rows = scored(documents, model).withColumn(key, _key(s, log))
    kept = [f"`{c}`" for c in (documents.columns if keep is None else keep)]
    model.scores = written(rows.select(*kept, *names), "scores")
    calibration = model.scores.filter(F.col(label).isNotNull()).select(log, label).toArrow()
    model.threshold = threshold(calibration[log].to_numpy(), np.array(calibration[label].to_pylist(), bool), s.kept, s.least)
    k = model.scores.filter(F.col(log) >= F.lit(float(model.threshold))).count()
    model.cut = kth_largest(model.scores, key, k)
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` with the log importance, and the label where a row calibrates the threshold."""
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    exact = F.col("text").cast("string").alias("text")
    rows = documents.select("doc_id", exact, *(f"`{c}`" for c in rest))
    log, label, _ = model.names
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    shared = rows.sparkSession.sparkContext.broadcast((model.ratios, model.labels))
    run = _score(shared, model.settings.bits, len(rows.columns), [*rows.columns, log, label])
    return rows.mapInArrow(run, f"{kinds}, {log} double, {label} boolean")


def accepted(model: Model) -> DataFrame:
    """The documents in the Gumbel top k, of those that the model was fitted on, with the columns kept."""
    log, label, key = model.names
    return model.scores.filter(F.col(key) >= F.lit(float(model.cut))).drop(log, label, key)


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, good_labels(table(spark, sf_dir, "labels")), keep=["doc_id"])
    return model.scores.select(
        "doc_id",
        "log_importance",
        F.lit(float(model.threshold)).alias("threshold"),
        "key",
        (F.col("key") >= F.lit(float(model.cut))).alias("accepted"),
    )

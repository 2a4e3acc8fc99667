"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of each ``window - k + 1`` consecutive k-gram hashes the smallest is a fingerprint, so any
span of ``window`` words that both sides share has a fingerprint in common. Fingerprints of documents that hit those of
the benchmark are extended to the windows that contain them, and the windows are joined with the benchmark's windows
on 128 bits. Items shorter than a window have no such guarantee; their whole word sequence is one window, looked up at
every position by its own length.

Two bit sets of a fixed size (``2 ** bits`` bits each) carry the benchmark's fingerprints and windows to the document
scan, whatever the size of the benchmark; they only spare the shuffle rows that cannot match. The join decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import blocks, table, text_bytes, with_row_id, written

WINDOW, K, BITS = 13, 5, 24
SALTS = 16
#: A-Z become a-z; ASCII that is neither digit nor letter parts words; all other bytes belong to words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONGS = pa.list_(pa.int64())


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out *= _STEP
        out += hashes[j : j + len(out)]
    out ^= out >> np.uint64(29)
    out *= _STEP + np.uint64(2 * n)
    return out ^ (out >> np.uint64(32))


def _same(owner: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from here on belong to one text."""
    return owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]


def _selected(hashes: np.ndarray, owner: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes and which of them are the least of some window inside one text."""
    grams, width = _grams(hashes, k), window - k + 1
    inside = _same(owner, window)
    if not len(inside):
        return grams, np.zeros(len(grams), bool)
    least = grams[: len(inside)].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + len(inside)], out=least)
    pick = np.zeros(len(grams), bool)
    for j in range(width):
        part = slice(j, j + len(inside))
        pick[part] |= inside & (grams[part] == least)
    return grams, pick


def _check(tokens: list[bytes], start: int, n: int) -> int:
    """A second, independent hash of a window's words."""
    return np.uint64(xxhash.xxh64_intdigest(b" ".join(tokens[start : start + n]), 7)).astype(np.int64).item()


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitset: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _slot(hashes, bits)
    return (bitset[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _item_windows(window: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """item_id, text -> a row for each distinct window of an item, with the fingerprints inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for item, text in zip(ids, text_bytes(batch.column(1)), strict=True):
                tokens = words(text)
                if not tokens:
                    continue
                n = min(window, len(tokens))
                hashes, owner = _hashes(tokens), np.zeros(len(tokens), np.int8)
                whole = _grams(hashes, n)
                grams, pick = _selected(hashes, owner, k, window)
                for i, w in enumerate(whole.astype(np.int64).tolist()):
                    part = slice(i, i + window - k + 1)
                    prints = grams[part][pick[part]].astype(np.int64).tolist() if n == window else []
                    out.append((item, n, w, _check(tokens, i, n), prints))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), _LONGS]
            names = ["item_id", "n", "w1", "w2", "prints"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _bitset(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit set over a column of hashes: a partial one for each of at most 8 tasks, joined on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            at = _slot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)
            np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary())], ["part"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    for row in hashes.coalesce(8).mapInArrow(run, "part binary").toLocalIterator():
        out |= np.frombuffer(bytes(row.part), np.uint8)
    return out


def _document_hits(window: int, k: int, bits: int, prints, windows, lengths: list[int]):
    """row_id, doc_id, text -> row_id, doc_id, n_words and the windows that may be the benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint_bits, window_bits = prints.value, windows.value
        hit_type = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())]))
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in blocks(map(len, texts), 2_000_000):
                parts = [words(t) for t in texts[a:b]]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                tokens = [w for p in parts for w in p]
                first = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(parts)), sizes)
                hashes = _hashes(tokens)
                found: list[list[tuple]] = [[] for _ in parts]

                def keep(starts, grams, n):
                    good = starts[_has(window_bits, grams, bits)]
                    good_grams = grams[_has(window_bits, grams, bits)].astype(np.int64).tolist()
                    for s, w in zip(good.tolist(), good_grams, strict=True):
                        found[owner[s]].append((s - first[owner[s]], n, w, _check(tokens, s, n)))

                grams, pick = _selected(hashes, owner, k, window)
                hit = np.flatnonzero(pick)
                hit = hit[_has(fingerprint_bits, grams[hit], bits)]
                if len(hit):  # extend each hit to the windows around it
                    starts = np.unique((hit[:, None] - np.arange(window - k + 1)[None, :]).ravel())
                    starts = starts[(starts >= 0) & (starts <= len(tokens) - window)]
                    starts = starts[owner[starts] == owner[starts + window - 1]]
                    whole = np.zeros(len(starts), np.uint64)
                    for j in range(window):
                        whole = whole * _STEP + hashes[starts + j]
                    whole ^= whole >> np.uint64(29)
                    whole *= _STEP + np.uint64(2 * window)
                    keep(starts, whole ^ (whole >> np.uint64(32)), window)
                for n in lengths:
                    starts = np.flatnonzero(_same(owner, n)) if len(tokens) >= n else np.zeros(0, np.int64)
                    if len(starts):
                        keep(starts, _grams(hashes, n)[starts], n)
                hits = [[dict(zip(("start", "n", "w1", "w2"), map(int, h), strict=True)) for h in f] for f in found]
                cols = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sizes), pa.array(hits, hit_type)]
                yield pa.RecordBatch.from_arrays(cols, ["row_id", "doc_id", "n_words", "hits"])

    return run


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITS
) -> DataFrame:
    """How much of each document (doc_id, text) lies in windows of benchmark items (item_id, text).

    Returns row_id, doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items (the ids as strings,
    in order) and spans (start, end of covered words, in order). Null and empty texts have no words and no hits; an item
    without words never occurs; repeated documents each get their row; an item id may stand on several rows, whose
    windows count for the one id. Other columns of either table are ignored.
    """
    spark = documents.sparkSession
    items = written(
        benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
            _item_windows(window, k),
            f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, n int, w1 long, w2 long, prints array<long>",
        ),
        "items",
    )
    lengths = sorted(r.n for r in items.select("n").distinct().collect() if r.n < window)  # at most 12 numbers
    prints = spark.sparkContext.broadcast(_bitset(items.select(F.explode("prints")), bits))
    windows = spark.sparkContext.broadcast(_bitset(items.select("w1"), bits))
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = written(
        with_row_id(documents.select("doc_id", F.col("text").cast("string").alias("text")))
        .select("row_id", "doc_id", "text")
        .mapInArrow(
            _document_hits(window, k, bits, prints, windows, lengths),
            f"row_id long, doc_id {kind}, n_words long, hits array<struct<start:int,n:int,w1:long,w2:long>>",
        ),
        "document-hits",
    )
    hits = docs.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.*")
    of_items = items.select("n", "w1", "w2", F.col("item_id").cast("string").alias("item")).distinct()
    # a window that a third of all documents have, as of a one-word item, is dealt to SALTS keys
    of_items = of_items.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    of_items = written(of_items, "item-windows")
    found = (
        hits.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
        .join(of_items, ["n", "w1", "w2", "salt"])
        .groupBy("row_id")
        .agg(
            F.array_sort(F.collect_set("item")).alias("items"),
            F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("runs"),
        )
        .withColumn(
            "spans",
            F.expr(
                "aggregate(runs, cast(array() as array<struct<start:int,end:int>>), (acc, x) -> "
                "case when size(acc) > 0 and element_at(acc, -1).end >= x.start then concat(slice(acc, 1, size(acc) - 1),"
                " array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, x.end) as end)))"
                " else concat(acc, array(struct(x.start as start, x.end as end))) end)"
            ),
        )
        .select("row_id", "items", "spans")
    )
    return docs.select("row_id", "doc_id", "n_words").join(found, "row_id", "left").select(
        "row_id",
        "doc_id",
        "n_words",
        F.expr("coalesce(aggregate(spans, 0L, (n, x) -> n + x.end - x.start), 0L)").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def contaminated(n_hit, n_words):
    """The rule: at least one word in twenty is covered."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )

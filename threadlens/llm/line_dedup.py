"""Substring dedup by hashing lines and their parts.

Lines are cut into units. Inside a line a unit ends behind a word whose hash is smaller than those of the line's ``REACH``
words on either side, so that cuts depend on the words nearby alone and a passage is cut alike in every line that holds it, but for a
few words at its ends. Units are normalised (ASCII case and white space), digested to 128 bits and grouped over all documents;
the earliest occurrence of each digest, by doc_id, text and place, stays.

Later occurrences are removed where they make up whole lines, however short, or stand in an unbroken run of repeated units
with at least ``run_words`` words (0: all repeated units go); shorter repeats of parts of lines are chance. Lines of under
``LINE_WORDS`` words are digested whole besides, and removed where the same line stands earlier; being a part of a longer one
isn't enough. Where words have no content-defined end, as in runs of one word, a unit ends after ``UNIT_WORDS`` words.
Removed spans are offsets in the original text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import table, text_bytes, with_row_id, written

REACH, LINE_WORDS, RUN_WORDS, UNIT_WORDS = 3, 5, 20, 16
#: Digests with more occurrences than the units over this number, fewer than as many, are joined by broadcast.
HOT = 10_000
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_UNIT = [
    ("u", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()),
    ("start", pa.int32()), ("end", pa.int32()), ("edge", pa.int32()),
]
_UNIT_SQL = "u int, h1 long, h2 long, n int, start int, end int, edge int"


def units(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised words joined, number of words, start, end (code points) and edge of each unit: 1 if it begins
    a line, plus 2 if it ends one."""
    words = text.lower().split()
    n = len(words)
    if not n:
        none = np.zeros(0, np.int64)
        return [], none, none, none, none
    raw = np.frombuffer(text, np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    line = np.cumsum(raw == 10)[start]
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    h = np.fromiter(map(zlib.crc32, words), np.int64, n)
    least = np.ones(n, bool)
    for k in range(1, min(REACH, n - 1) + 1):  # words of other lines don't count
        other = line[k:] != line[:-k]
        least[k:] &= (h[k:] < h[:-k]) | other
        least[:-k] &= (h[:-k] <= h[k:]) | other
    new_line = np.concatenate([line[1:] != line[:-1], [True]])
    cut = least | new_line
    begin = np.concatenate([[True], cut[:-1]])
    since = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    last = np.flatnonzero(cut | (since % UNIT_WORDS == UNIT_WORDS - 1))
    first = np.concatenate([[0], last[:-1] + 1])
    begins = np.concatenate([[True], line[1:] != line[:-1]])
    parts = [b" ".join(words[a : b + 1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return parts, last - first + 1, point[start[first]], point[end[last]], begins[first] + 2 * new_line[last]


def _short_lines(parts: list[bytes], n: np.ndarray, start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lines of under LINE_WORDS words: their words behind a line feed, which no unit has; and by row u, words, start, end,
    edge: 4 plus the number of their units, which follow from u on."""
    first, last = np.flatnonzero(edge & 1), np.flatnonzero(edge & 2)
    words = np.add.reduceat(n, first) if len(first) else n
    short = words < LINE_WORDS
    first, last = first[short], last[short]
    lines = [b"\n" + b" ".join(parts[a : b + 1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return lines, np.stack([first, words[short], start[first], end[last], last - first + 5])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_id, doc_id, text, tie -> row_id, doc_id, tie, n_chars, n_words, n_units, units."""
    for batch in batches:
        texts = text_bytes(batch.column(2))
        sizes, listed_sizes, cols, chars, words = [], [], [[] for _ in _UNIT], [], []
        for text in texts:
            parts, n, start, end, edge = units(text)
            lines, more = _short_lines(parts, n, start, end, edge)
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, [*parts, *lines])), "<i8").reshape(-1, 2)
            both = [np.concatenate(x) for x in zip((np.arange(len(n)), n, start, end, edge), more, strict=True)]
            for c, v in zip(cols, (both[0], digests[:, 0], digests[:, 1], *both[1:]), strict=True):
                c.append(v)
            sizes.append(len(n))
            listed_sizes.append(len(n) + len(lines))
            words.append(int(n.sum()))
            chars.append(len(text) if text.isascii() else len(text.decode("utf-8", "replace")))
        flat = [pa.array(np.concatenate(c) if c else [], t) for c, (_, t) in zip(cols, _UNIT, strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(listed_sizes)]), pa.int32())
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, [k for k, _ in _UNIT]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], batch.column(3), *(pa.array(x, pa.int64()) for x in (chars, words, sizes)), listed],
            ["row_id", "doc_id", "tie", "n_chars", "n_words", "n_units", "units"],
        )


def _whole_lines(run: list[dict]) -> list[dict]:
    """Of consecutive units those that make up whole lines of enough words."""
    out, line = [], []
    for x in run:
        line = [x] if x["edge"] & 1 else [*line, x] if line else []
        if line and x["edge"] & 2:
            if sum(y["n"] for y in line) >= LINE_WORDS:
                out += line
            line = []
    return out


def _runs(run_words: int):
    """row_id, repeated (units in order) -> row_id, spans that go, words that go."""
    return lambda batches: _runs_of(batches, run_words)


def _runs_of(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, gone = [], []
        for found in batch.column(1).to_pylist():
            lines = [x for x in found if x["edge"] > 4]
            found = [x for x in found if x["edge"] < 4]
            goes: dict[int, dict] = {}
            i = 0
            while i < len(found):
                j = i
                while j + 1 < len(found) and found[j + 1]["u"] == found[j]["u"] + 1:
                    j += 1
                run = found[i : j + 1]
                if sum(x["n"] for x in run) < run_words:
                    run = _whole_lines(run)
                goes |= {x["u"]: x | {"last": x["u"]} for x in run}
                i = j + 1
            for x in lines:
                last = x["u"] + x["edge"] - 5
                for u in range(x["u"], last + 1):
                    goes.pop(u, None)
                goes[x["u"]] = x | {"last": last}
            out: list[list[int]] = []
            words, last = 0, None
            for u, x in sorted(goes.items()):
                if last is not None and u == last + 1:
                    out[-1][1] = x["end"]
                else:
                    out.append([x["start"], x["end"]])
                last, words = x["last"], words + x["n"]
            spans.append([{"start": a, "end": b} for a, b in out])
            gone.append(words)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, kind), pa.array(gone, pa.int64())], ["row_id", "spans", "n_gone"]
        )


def dedup_lines(documents: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Which spans of each document (doc_id, text) repeat an earlier document or an earlier place in it.

    Returns row_id, doc_id, n_chars, n_words, n_units, n_gone (words removed),
    spans (start, end in code points, in order). Null and empty texts have no units; of equal doc_ids that with the lesser
    hash of the text is earlier, of equal rows one; null doc_ids come first. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(documents.select("doc_id", F.col("text").cast("string").alias("text")))
    listed = _UNIT_SQL.replace(" ", ":").replace(",:", ",")
    kinds = f"row_id long, doc_id {kind}, tie long, n_chars long, n_words long, n_units long, units array<struct<{listed}>>"
    rows = rows.select("row_id", "doc_id", "text", F.xxhash64("text").alias("tie"))
    scanned = written(rows.mapInArrow(_scan, kinds), "units")
    each = scanned.select("row_id", "doc_id", "tie", F.explode("units").alias("x")).select("row_id", "doc_id", "tie", "x.*")
    place = F.struct("doc_id", "tie", "row_id", "u")
    first = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = written(first.select("h1", "h2", F.col("first.row_id").alias("r0"), F.col("first.u").alias("u0"), "times"), "repeated")
    # frequent digests, of which there can't be more than HOT, don't meet at one key each
    most = (scanned.agg(F.sum(F.size("units"))).first()[0] or 0) // HOT
    hot = F.broadcast(first.filter(F.col("times") > most).select("h1", "h2", F.col("r0").alias("hot_r"), F.col("u0").alias("hot_u")))
    each = each.drop("doc_id", "tie").join(hot, ["h1", "h2"], "left")
    cold = each.filter("hot_r is null").drop("hot_r", "hot_u").join(first.filter(F.col("times") <= most).drop("times"), ["h1", "h2"])
    warm = each.filter("hot_r is not null").withColumnsRenamed({"hot_r": "r0", "hot_u": "u0"})
    later = cold.unionByName(warm).filter("row_id != r0 or u != u0")
    gone = later.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("u", "n", "start", "end", "edge"))).alias("repeated"))
    gone = gone.select("row_id", "repeated").mapInArrow(
        _runs(run_words), "row_id long, spans array<struct<start:int,end:int>>, n_gone long"
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return scanned.join(gone, "row_id", "left").select(
        "row_id",
        "doc_id",
        "n_chars",
        "n_words",
        "n_units",
        F.coalesce("n_gone", F.lit(0)).alias("n_gone"),
        F.coalesce("spans", none).alias("spans"),
    )


def without(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    parts = F.transform(spans, lambda x, i: F.substring(text, F.get(ends, i) + 1, x["start"] - F.get(ends, i)))
    return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_chars", "n_words", "n_units", "n_gone", spans.alias("spans"))

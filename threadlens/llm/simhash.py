"""SimHash near-duplicates found with BK-trees.

Each document's word shingles vote on the bits of a fingerprint. Distinct fingerprints are dealt to shards by keys made of
some of their bits; each shard has a BK-tree (children keyed by their Hamming distance to the parent), and each of its
members is looked up in it, following only edges within the radius. Links become components.

Up to a radius of 3, keys are exact: the bits are cut into radius + 2 blocks, and any two fingerprints within the radius
agree in two blocks at least, so each pair of blocks is a key. For larger radii no short exact cover exists; keys are
then pseudo-random samples of bits, as many as give ``recall`` for a pair that differs in ``radius`` bits.

With ``jaccard``, fingerprints only find candidates: all texts of a component of theirs are compared by their exact sets
of shingles, and only pairs as similar as that are links.

A shard's tree holds at most ``shard_rows`` rows: a key with more is cut into chunks, and each pair of chunks is a cell with
the tree of one and the queries of both. A cell returns a spanning forest of the links it found, not all pairs, so no
link between components is lost and no cell's output exceeds its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import table, text_bytes, with_row_id, written

SEED = 42
SALTS = 8
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    """shingle: words in one. distinct: each different shingle votes once, however often it repeats. words64: fingerprint width in units of 64 bits. radius: differing bits of a link.
    recall: of pairs at the radius, where that is beyond 3. key_bits: least size of such keys. jaccard: of the distinct
    shingles of a link; None: links are decided by the radius. chunk: shingles of a large component compared at once, about."""

    shingle: int = 3
    words64: int = 1
    radius: int = 2
    recall: float = 0.95
    key_bits: int = 16
    shard_rows: int = 4096
    distinct: bool = False
    jaccard: float | None = None
    chunk: int = 1_000_000


#: Five words and a similarity of 0.8: sets as similar as that have shingle vectors at a cosine of 0.89, whose SimHash
#: bits differ with probability 0.151: 38.7 of 256, with a standard deviation of 5.7. The radius is 2.3 of these above.
FIVE_WORDS = Settings(shingle=5, words64=4, radius=52, recall=0.95, key_bits=12, distinct=True, jaccard=0.8)


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    h = h + np.uint64(step)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _votes(h: np.ndarray, words64: int) -> np.ndarray:
    """How many of the hashes have each bit, least significant first."""
    total = np.zeros(64 * words64, np.int64)
    for a in range(0, len(h), 255 * 16):
        part = h[a : a + 255 * 16]
        wide = np.stack([part, *(_mixed(part, _MIX[i]) for i in range(words64 - 1))], 1)
        bits = np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            total += bits[b : b + 255].sum(0, dtype=np.uint8)
    return total


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The hash of each shingle in order; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = 3, words64: int = 1, distinct: bool = False) -> np.ndarray:
    """The bits set in over half of the shingles' hashes, as words64 unsigned numbers; no words: all zero."""
    h = shingles(text, shingle)
    return _fingerprint(np.unique(h) if distinct else h, words64)


def _fingerprint(h: np.ndarray, words64: int) -> np.ndarray:
    if not len(h):
        return np.zeros(words64, np.uint64)
    on = 2 * _votes(h, words64) > len(h)
    return np.packbits(on, bitorder="little").view("<u8").astype(np.uint64)


def _fingerprints(shingle: int, words64: int, distinct: bool, exact: bool):
    """row_id, doc_id, text, text_hash -> row_id, doc_id, fp (big-endian bytes, most significant number first); if exact,
    text_hash, node (a digest of the set of shingles) and its size too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, sizes = [], [], []
            for t in text_bytes(batch.column(2)):
                h = shingles(t, shingle)
                if distinct or exact:
                    once = np.unique(h)
                    h = once if distinct else h
                if exact:
                    nodes.append(xxhash.xxh3_128_digest(once.tobytes()))
                    sizes.append(len(once))
                fps.append(_fingerprint(h, words64)[::-1].astype(">u8").tobytes())
            cols, names = [*batch.columns[:2], pa.array(fps, pa.binary())], ["row_id", "doc_id", "fp"]
            if exact:
                cols += [batch.column(3), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64())]
                names += ["text_hash", "node", "size"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _key_bits(s: Settings, distinct: int) -> list[np.ndarray]:
    """The bit positions of each key."""
    width = 64 * s.words64
    if s.radius <= 3:
        parts = np.array_split(np.arange(width), s.radius + 2)
        return [np.concatenate(pair) for pair in combinations(parts, 2)]
    # keys grow with the number of fingerprints, so that chance leaves about as many rows in a shard at every size
    size = max(s.key_bits, math.ceil(math.log2(max(2, distinct))) - 6)
    # that none of a key's positions, drawn without replacement, is one of the radius that differ
    agree = math.prod((width - s.radius - i) / (width - i) for i in range(size))
    number = math.ceil(math.log(1 - s.recall) / math.log1p(-agree))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.permutation(width)[:size]) for _ in range(number)]


def _keys(key_bits: list[np.ndarray]):
    """fp -> key, fp; a key's number is mixed into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            if not raw:
                continue
            for a in range(0, len(raw), 4096):
                part = raw[a : a + 4096]
                bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1), axis=1)
                for i, at in enumerate(key_bits):
                    packed = np.packbits(bits[:, at], axis=1)
                    padded = np.zeros((len(part), -(-packed.shape[1] // 8) * 8), np.uint8)
                    padded[:, : packed.shape[1]] = packed
                    key = _mixed(np.full(len(part), i + 1, np.uint64), _MIX[1])  # short keys of two numbers stay apart
                    for number in padded.view("<u8").T:
                        key = _mixed(key ^ number, _MIX[0])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part, pa.binary())], ["key", "fp"])

    return run


def _distance(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count(fps[a] ^ fps[b])
    far = differ[:, 0].astype(np.int64)
    for column in differ.T[1:]:
        far += column
    return far


class Forest:
    """BK-trees of many shards, built level by level: node i has children at child[first[i]:first[i + 1]], by distance."""

    def __init__(self, fps: np.ndarray, rows: np.ndarray, shard: np.ndarray):
        """rows: positions in fps, ordered by shard; shard: the number of each row's tree. All trees grow together."""
        self.fps = fps
        group, waiting = shard, rows
        parents, children, labels = [], [], []
        above = np.full(len(fps), -1, np.int64)
        label = np.zeros(len(fps), np.int64)
        self.root: dict[int, int] = {}
        level = 0
        while len(waiting):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            nodes = waiting[new]
            if level == 0:
                self.root = dict(zip(group[new].tolist(), nodes.tolist(), strict=True))
            else:
                parents.append(above[nodes])
                children.append(nodes)
                labels.append(label[nodes])
            top = nodes[np.cumsum(new) - 1]
            rest = ~new
            waiting, top, group = waiting[rest], top[rest], group[rest]
            far = _distance(fps, waiting, top)
            above[waiting], label[waiting] = top, far
            order = np.lexsort((waiting, far, top))
            waiting, top, far = waiting[order], top[order], far[order]
            group = top * 1024 + far  # a tree's branch: below one node, at one distance
            level += 1
        if parents:
            p, c, d = map(np.concatenate, (parents, children, labels))
            order = np.lexsort((d, p))
            self.edge, self.child = (p * 1024 + d)[order], c[order]
        else:
            self.edge, self.child = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.label = self.edge % 1024
        self.first = np.searchsorted(self.edge, np.arange(len(fps) + 1) * 1024, "left")

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at the radius or less; a stack of bounded frontiers."""
        stack = [(queries[a : a + most // 8], roots[a : a + most // 8]) for a in range(0, len(queries), most // 8)]
        while stack:
            query, node = stack.pop()
            if len(query) > most:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = _distance(self.fps, query, node)
            hit = far <= radius
            yield query[hit], node[hit]
            if radius > 3:  # few children are out of reach: read all, then drop those
                low, high = self.first[node], self.first[node + 1]
            else:
                low = np.searchsorted(self.edge, node * 1024 + np.maximum(far - radius, 0), "left")
                high = np.searchsorted(self.edge, node * 1024 + np.minimum(far + radius, 1023), "right")
            n = high - low
            total = int(n.sum())
            if total:
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
                query = np.repeat(query, n)
                if radius > 3:
                    near = np.abs(self.label[at] - np.repeat(far, n)) <= radius
                    query, at = query[near], at[near]
                stack.append((query, self.child[at]))


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union: hang larger roots below smaller ones until all pairs agree."""
    while len(a):
        parent = _root(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return _root(parent)


def _links(radius: int, words64: int, most: int = 100_000):
    """cell, query, fp ordered by cell -> fp, other: a spanning forest of each cell's links.

    Rows with query = false are in the cell's tree and are queries too, those with true only queries."""

    def solve(cells: np.ndarray, query: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        fps = np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), words64).astype(np.uint64)
        number = np.cumsum(np.concatenate([[0], cells[1:] != cells[:-1]]))
        rows = np.flatnonzero(~query)
        parent = np.arange(len(raw))
        if len(rows):
            forest = Forest(fps, rows, number[rows])
            roots = np.array([forest.root.get(k, -1) for k in range(int(number[-1]) + 1)], np.int64)[number]
            # a cell with queries of its own only links them to its tree; the tree's own chunk has a cell too
            only = np.zeros(int(number[-1]) + 1, bool)
            np.logical_or.at(only, number, query)
            ask = np.flatnonzero((roots >= 0) & (query | ~only[number]))
            for a, b in forest.within(ask, roots[ask], radius):
                apart = parent[a] != parent[b]
                parent = _join(parent, a[apart], b[apart])
        out = np.flatnonzero(parent != np.arange(len(raw)))
        return pa.RecordBatch.from_arrays(
            [pa.array([raw[i] for i in out], pa.binary()), pa.array([raw[i] for i in parent[out]], pa.binary())], ["fp", "other"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, query, raw = np.zeros(0, np.int64), np.zeros(0, bool), []
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            query = np.concatenate([query, batch.column(1).to_numpy(zero_copy_only=False).astype(bool)])
            raw += batch.column(2).to_pylist()
            if len(raw) >= most:  # whole cells only; a cell has at most two chunks
                cut = int(np.argmax(cells == cells[-1]))
                if cut:
                    yield solve(cells[:cut], query[:cut], raw[:cut])
                    cells, query, raw = cells[cut:], query[cut:], raw[cut:]
        if raw:
            yield solve(cells, query, raw)

    return run


def links(fps: DataFrame, s: Settings) -> DataFrame:
    """fp, other: edges that connect all distinct fingerprints (column fp) within the radius, directly or in steps."""
    key_bits = _key_bits(s, fps.count())
    keys = fps.mapInArrow(_keys(key_bits), "key long, fp binary")
    chunk = F.lit(s.shard_rows // 2)
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    counts = written(counts.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "shards")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("chunks")).cast("int")
    cells = (
        keys.join(counts, "key")
        .withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
        .select(
            F.xxhash64("key", F.least("own", "c"), F.greatest("own", "c")).alias("cell"),
            (F.col("own") > F.col("c")).alias("query"),
            "fp",
        )
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.repartition(n, "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_links(s.radius, s.words64), "fp binary, other binary")
        .distinct()
    )


def components(edges: DataFrame, a: str, b: str, most: int = 40) -> DataFrame:
    """node, root: the least node of each component, for every node of an edge.

    Alternates large stars and small stars until edges no longer change, which takes O(log squared n) rounds; each round
    is written, so a lost executor costs one round at most. The edges of one node, which may be those of a star of very many,
    meet its least neighbour at SALTS keys. Raises if ``most`` rounds don't suffice.
    """
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")

    def with_least(edges: DataFrame) -> DataFrame:
        """u, v, salt, m: each edge with the least v of its u."""
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", salts)
        return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"])

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now, before = written(now, "edges"), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")
        large = written(large.distinct(), "large-star")
        joined = with_least(large)
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.filter("v = m").select("u", F.col("m").alias("v"))
        )
        now = written(small.distinct(), "small-star")
        mark = stamp(now)
        if mark == before:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
        before = mark
    raise RuntimeError("components did not settle")


def _similar(cells: list[int], sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """The root of each set: unions of all pairs within a cell whose Jaccard is high enough. Equal cells are neighbours."""
    parent, cell = np.arange(len(sets)), np.array(cells, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a == 1:
            continue
        sizes = np.array([len(x) for x in sets[a:b]])
        token = np.unique(np.concatenate(sets[a:b]), return_inverse=True)[1]
        owner = np.repeat(np.arange(b - a), sizes)[np.argsort(token, kind="stable")]  # by token, then set
        first = np.concatenate([[0], np.cumsum(np.bincount(token))])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(1, b - a):
            t = token[ends[i] : ends[i + 1]]
            n = first[t + 1] - first[t]
            total = int(n.sum())
            if total == len(t):
                continue  # none of its shingles is in another set
            at = np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(total)
            both = np.bincount(owner[at], minlength=b - a)[:i]
            hit = np.flatnonzero((both > 0) & (both >= jaccard * (sizes[:i] + sizes[i] - both) - 1e-9)) + a
            hit = hit[parent[hit] != parent[a + i]]
            if len(hit):
                parent[a:b] = _join(parent[a:b] - a, np.full(len(hit), i), hit - a) + a
    return parent


def _exact(shingle: int, jaccard: float, most: int = 2_000_000):
    """cell, node, text ordered by cell -> node, other: a spanning forest of the links in each cell."""

    def solve(cells: list[int], nodes: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        parent = _similar(cells, sets, jaccard)
        out = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in out], pa.binary()), pa.array([nodes[i] for i in parent[out]], pa.binary())], ["node", "other"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, held = None, set(), 0
        cells, nodes, sets = [], [], []
        for batch in batches:
            for cell, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                if cell != last:
                    if held > most:
                        yield solve(cells, nodes, sets)
                        cells, nodes, sets, held = [], [], [], 0
                    last, seen = cell, set()
                if node in seen:
                    continue
                h = np.unique(shingles(text, shingle))
                if xxhash.xxh3_128_digest(h.tobytes()) == node:
                    seen.add(node)
                    cells.append(cell)
                    nodes.append(node)
                    sets.append(h)
                    held += len(h)
        if nodes:
            yield solve(cells, nodes, sets)

    return run


def _verified(rows: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """node, other: edges that connect all nodes of a candidate component with exact similarity, directly or in steps.

    rows: doc_id, text. nodes: node, size, root of its candidate component, some (doc_id and text_hash of a row of it).
    A component of over s.chunk shingles is cut into chunks, and each pair of chunks is a cell."""
    sums = nodes.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).filter("n > 1")
    sums = sums.select("root", F.greatest(F.lit(1), F.ceil(F.col("size") / s.chunk)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    asked = nodes.drop("size").join(sums, "root").select("node", "root", "some", "chunks", own.alias("own"))
    asked = written(asked, "asked").alias("a")
    texts = rows.withColumn("text_hash", F.xxhash64("text")).alias("t")
    same = (F.col("t.text_hash") == F.col("a.some.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("a.some.doc_id"))
    cells = asked.join(texts, same).select("node", "root", "own", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    cells = cells.select(F.xxhash64("root", F.least("own", "c"), F.greatest("own", "c")).alias("cell"), "node", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.repartition(n, "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_exact(s.shingle, s.jaccard), "node binary, other binary")
        .distinct()
    )


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """row_id, doc_id, fp, component: the least doc_id among all rows that links reach from this one, itself included.

    Null and empty texts have the fingerprint zero and link to each other like any others. Repeated rows share their
    fingerprint. Null doc_ids count as larger than any other; a component of nulls has a null id. Other columns are
    ignored.
    """
    s, exact = settings, settings.jaccard is not None
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    prints = with_row_id(texts).select("row_id", "doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _fingerprints(s.shingle, s.words64, s.distinct, exact),
        f"row_id long, doc_id {kind}, fp binary" + (", text_hash long, node binary, size long" if exact else ""),
    )
    prints = written(prints, "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = components(links(distinct.select("fp"), s), "fp", "other")
    of = written(of.select(F.col("node").alias("fp"), "root"), "roots")
    known = distinct.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    known = written(known, "known")
    by = "fp"
    if exact:
        by, some = "node", F.min(F.struct("doc_id", "text_hash")).alias("some")
        nodes = prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("least"), some)
        nodes = written(nodes.join(known.select("fp", "root"), "fp").drop("fp"), "nodes")
        of = components(_verified(texts, nodes.drop("least"), s), "node", "other")
        known = nodes.select("node", "least").join(written(of, "exact-roots"), "node", "left")
        known = written(known.select("node", F.coalesce("root", "node").alias("root"), "least"), "exact-known")
    ids = written(known.groupBy("root").agg(F.min("least").alias("component")), "ids")
    of = written(known.join(ids, "root").select(by, "component"), "components")
    return prints.join(of, by).select("row_id", "doc_id", "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))

"""Retrieval: best examples by cosine, one of each template, and near-duplicates by character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.text import unit
from threadlens.sources.tables import cut, discard


def _best(k: int, floor: float):
    """c_id, c_template, c_vector, q_id, q_vector, a chunk against a block -> query_id, vec_id, template, sim: for each query
    the k best of the chunk, one of each template."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                ids, names, q_ids = np.asarray(r.c_id), np.asarray(r.c_template, object), np.asarray(r.q_id)
                sims = np.round(np.stack(r.q_vector) @ np.stack(r.c_vector).T, 6)
                for q, row in zip(q_ids, sims, strict=True):
                    fit = np.flatnonzero((row >= floor) & (ids != q))
                    seen, left = set(), k
                    for i in fit[np.lexsort((ids[fit], -row[fit]))]:
                        if names[i] and names[i] in seen:
                            continue
                        seen.add(names[i])
                        out.append((q, ids[i], names[i], row[i]))
                        left -= 1
                        if not left:
                            break
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "template", "sim"])

    return run


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.5, chunk: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, sim: the k most similar vectors of at least ``floor``, the best of each template only.

    corpus: vec_id, embedding, template; queries: query_id, embedding; vectors of one length. The query set is the stated one.
    Chunks of the corpus meet blocks of queries as matrices, and only a chunk's best k for a query leave it. Sims are
    rounded to 6 digits; ties go to the lower id; an empty or null template never excludes.
    """
    c_parts, q_parts = (max(1, -(-d.count() // chunk)) for d in (corpus, queries))
    dealt = lambda i, n: F.pmod(F.xxhash64(i), F.lit(n)).cast("int")
    c = corpus.select("vec_id", F.coalesce("template", F.lit("")).alias("template"), unit(F.col("embedding")).alias("v"))
    q = queries.select("query_id", unit(F.col("embedding")).alias("u")).withColumn("block", dealt("query_id", q_parts))
    blocks = q.groupBy("block").agg(F.collect_list("query_id").alias("q_id"), F.collect_list("u").alias("q_vector"))
    chunks = c.withColumn("chunk", dealt("vec_id", c_parts)).groupBy("chunk")
    chunks = chunks.agg(*(F.collect_list(x).alias(y) for x, y in (("vec_id", "c_id"), ("template", "c_template"), ("v", "c_vector"))))
    all_blocks = F.array(*map(F.lit, range(q_parts)))
    pairs = chunks.withColumn("block", F.explode(all_blocks)).join(blocks, "block")
    kinds = corpus.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    pairs = pairs.select("c_id", "c_template", "c_vector", "q_id", "q_vector")
    found = pairs.mapInPandas(_best(k, floor), f"query_id {kinds[1]}, vec_id {kinds[0]}, template string, sim double")
    order = [F.desc("sim"), "vec_id"]
    own = F.when(F.col("template") == "", F.col("vec_id").cast("string")).otherwise(F.lit(""))
    best = found.withColumn("r", F.row_number().over(W.partitionBy("query_id", "template", own).orderBy(*order))).filter("r = 1")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= k
    ).select("query_id", "rank", "vec_id", "sim")


def grams(text: str, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of ``least`` to ``most`` within words padded by a space on either side, lower case, repeats
    included. A word of no more characters than n is one n-gram for the least such n and has none longer."""
    return F.expr(rf"""
        flatten(transform(filter(split(lower({text}), r'\s+'), w -> w <> ''), w ->
            flatten(transform(sequence({least}, least({most}, greatest({least}, length(w) + 2))), n ->
                transform(sequence(1, greatest(1, length(w) + 3 - n)), i -> substring(concat(' ', w, ' '), i, n))))))
    """)


def vectors(texts: DataFrame, keys: list[str], max_df: float = 0.2) -> DataFrame:
    """keys, g, w, df: texts (keys, text, m) as vectors of length 1 over n-grams of 3 to 5 characters, weighted by 1 + ln(count) and
    by inverse frequency; df: the texts that have the n-gram, each counted m times. N-grams that over ``max_df`` of all
    texts have don't count. Written, as its readers are several."""
    n = texts.agg(F.sum("m")).first()[0] or 0
    g = texts.select(*keys, "m", F.explode(grams("text")).alias("g")).groupBy(*keys, "m", "g").agg(F.count("*").alias("tf"))
    g = cut(g)
    df = g.groupBy("g").agg(F.sum("m").alias("df")).filter(F.col("df") <= max_df * n)
    weight = (1 + F.log("tf")) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))
    return cut(g.join(df, "g").select(*keys, "g", weight.alias("w"), "df").select(*keys, "g", (F.col("w") / norm).alias("w"), "df"))


def prefixes(vectors: DataFrame, least: float) -> DataFrame:
    """id, g: the n-grams of each vector, rare ones first, up to where what is left is shorter than ``least``."""
    behind = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id").orderBy(F.desc("df"), F.desc("g")).rowsBetween(W.unboundedPreceding, 0))
    return vectors.withColumn("rest", F.sqrt(behind)).filter(F.col("rest") >= least - _SLACK).select("id", "g")


def pairs_above(left: DataFrame, right: DataFrame, least: float, unlike: bool = True) -> DataFrame:
    """a, b, s: all pairs of a row of left (id, g, w, df of ``vectors``) and one of right, of unlike ids if ``unlike``, whose cosine s
    is at least ``least`` (over 0).

    N-grams are ordered by their frequency, rare ones first, alike for all vectors. A vector's prefix ends where what is left has a
    length below ``least``: vectors that share no n-gram of both prefixes can't be as alike as that, so only prefixes meet,
    and the cosines of those that do are worked out in full.
    """
    a, b = prefixes(left, least).withColumnRenamed("id", "a"), prefixes(right, least).withColumnRenamed("id", "b")
    met = a.join(b, "g").filter(F.col("a") != F.col("b") if unlike else F.lit(True)).select("a", "b").distinct()
    x, y = left.select(F.col("id").alias("a"), "g", F.col("w").alias("x")), right.select(F.col("id").alias("b"), "g", F.col("w").alias("y"))
    dots = met.join(x, "a").join(y, ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return dots.filter(F.col("s") >= least)


_SLACK = 2e-9
#: The share of a threshold that what is left of a vector must be shorter than, for its rare n-grams to tell what may reach the threshold.
_MET = 0.9
#: N-grams by which a text looks for first matches, and how many of these are worked out.
_SEEDS, _FIRST = 12, 3


def _bounded(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What has to be compared: (o, g, size, w, met, rest, floor) of all n-grams of other texts that training texts have, and the
    training texts' postings (g, size, t, t_w); size: a class of training texts by the number of their n-grams.

    floor: the best cosine of a few promising training texts, found by the text's rarest n-grams: the best can't be less. For
    training texts of each size, the n-grams that cost most and can add least are left out (met is false) as long as their share
    of any cosine, at most their length and at most their weights times the greatest ones of those training texts, stays below
    the floor; rest is the share left out. A training text that meets none of the others can't be best; weights in
    long texts are small, so these often need not meet at all.
    """
    size = F.floor(2 * F.log2(F.count("*").over(W.partitionBy("id")))).cast("int")
    postings = cut(train.select("g", size.alias("size"), F.col("id").alias("t"), F.col("w").alias("t_w")))
    known = postings.groupBy("g", "size").agg(F.count("*").alias("posts"), F.max("t_w").alias("top"))
    o = cut(other.select(F.col("id").alias("o"), "g", "w").join(known, "g"))
    rare = F.row_number().over(W.partitionBy("o").orderBy(F.desc(F.col("w") * F.col("top") / F.col("posts")), "g", "size"))
    seeds = o.withColumn("r", rare).filter(F.col("r") <= _SEEDS).join(postings, ["g", "size"])
    part = seeds.groupBy("o", "t", "size").agg(F.sum(F.col("w") * F.col("t_w")).alias("s"))
    first = part.withColumn("r", F.row_number().over(W.partitionBy("o").orderBy(F.desc("s"), "t"))).filter(F.col("r") <= _FIRST).select("o", "t", "size")
    floor = first.join(o, ["o", "size"]).join(postings, ["t", "g", "size"]).groupBy("o", "t").agg(F.sum(F.col("w") * F.col("t_w")).alias("floor"))
    floor = floor.groupBy("o").agg(F.max("floor").alias("floor"))
    common = W.partitionBy("o", "size").orderBy(F.desc(F.col("posts") / (F.col("w") * F.col("top"))), "g").rowsBetween(W.unboundedPreceding, 0)
    share = F.least(F.sqrt(F.sum(F.col("w") * F.col("w")).over(common)), F.sum(F.col("w") * F.col("top")).over(common))
    rows = o.join(floor, "o").withColumn("share", share).withColumn("met", F.col("share") >= F.col("floor") - _SLACK)
    rest = F.max(F.when(~F.col("met"), F.col("share")).otherwise(0.0)).over(W.partitionBy("o", "size"))
    return cut(rows.select("o", "g", "size", "w", "met", rest.alias("rest"), "floor")), postings


#: Characters of training texts that a task counts and compares with half as many of others, and n-grams of texts that it counts at once.
BLOCK, _CELLS = 1 << 22, 1 << 20
#: Which bytes Java's \s takes.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _coded(values) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in the order in which values first appear, and the value of each number."""
    found = pa.array(values).dictionary_encode() if isinstance(values, np.ndarray) else values.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order in which pairs first appear."""
    (i, _), (j, known) = _coded(a), _coded(b)
    return _coded(i * max(1, len(known)) + j)[0]


def _word_grams(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words, the number of ``grams`` each has; the numbers of all of them, word by word; and the n-grams by number as two longs, of
    the first three characters and of what follows (0 for none)."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(b" ", words.type))[0].as_py()
    c = np.frombuffer((b" " + joined + b"   ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    space = c == 32
    three = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    three, space = np.append(three, [0, 0, 0, 0]), np.append(space, [True, True])
    at = np.flatnonzero(~space[1:-2])  # n-grams from here have a character second
    # of n-grams of three, four and five from each place: those that have no space inside
    within = np.stack([np.ones(len(at), bool), ~space[at + 2], ~space[at + 2] & ~space[at + 3]], 1)
    first, known = _coded(three[: len(c)])
    key = first[at] * (len(known) + 1)
    key = np.stack([key, key + first[at + 1] + 1, key + first[at + 2] + 1], 1) * 3 + np.arange(3)  # longer ones by two of three that overlap
    g, known = _coded(key[within])
    of = np.repeat(at, within.sum(1))
    new = np.diff(np.maximum.accumulate(g), prepend=-1) > 0
    at, n = of[new], known.to_numpy() % 3 + 3
    a, b = three[at], np.where(n > 3, c[at + 3 - (n < 4)] + 1 << 21, 0) | np.where(n > 4, c[at + 4 - 2 * (n < 5)] + 1, 0)
    return np.bincount(np.cumsum(space[: len(c)])[of + 1] - 1, minlength=len(words)), g, a, b


class _Counts:
    """The n-grams of some texts, lower case and in UTF-8: a, b of ``_word_grams``, and ``cells``."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        black = ~_SPACE[data]
        edge = np.diff(black, prepend=False)
        starts, ends = np.flatnonzero(edge & black), np.flatnonzero(edge & ~black)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[black])])
        w, known = _coded(words)
        self.sizes, self.grams, self.a, self.b = _word_grams(known)
        self.starts = np.cumsum(self.sizes) - self.sizes
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        pairs, self.times = np.unique(text * max(1, len(known)) + w, return_counts=True)
        self.text, self.word = pairs // max(1, len(known)), pairs % max(1, len(known))

    def cells(self):
        """Of some whole texts after others: text, n-gram and how often the text has it, each pair once."""
        n = self.sizes[self.word]
        ends, lo = np.cumsum(n), 0
        while lo < len(n):
            # up to the end of the text in which the n-grams get too many
            last = min(len(n) - 1, int(np.searchsorted(ends, ends[lo] - n[lo] + _CELLS)))
            hi = int(np.searchsorted(self.text, self.text[last], "right"))
            k, text, word, times = n[lo:hi], self.text[lo:hi], self.word[lo:hi], self.times[lo:hi]
            at = np.arange(k.sum()) + np.repeat(self.starts[word] - np.cumsum(k) + k, k)
            keys, times, bits = np.repeat((text - text[0]) * len(self.a), k) + self.grams[at], np.repeat(times, k), int(times.max()).bit_length()
            if int(keys.max()).bit_length() + bits < 64:  # sorted faster as one number
                keys = keys << bits | times
                keys.sort()
                keys, times = keys >> bits, keys & (1 << bits) - 1
            else:
                order = np.argsort(keys)
                keys, times = keys[order], times[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            keys = keys[new]
            yield text[0] + keys // len(self.a), keys % len(self.a), np.add.reduceat(times, new)
            lo = hi

    def texts_with(self, m: np.ndarray) -> np.ndarray:
        """For each n-gram the texts that have it, each counted m times."""
        return sum((np.bincount(g, m[t], len(self.a)) for t, g, _ in self.cells()), np.zeros(len(self.a)))


def _block_counts(block: pa.Table) -> pa.Table:
    """block, a, b, m: of a block of texts (block, m, text), each n-gram and the texts that have it, each counted m times."""
    counts = _Counts(block.column("text").to_pylist())
    m = counts.texts_with(block.column("m").to_numpy()).astype(np.int64)
    return pa.table([pa.array(np.full(len(m), block.column("block")[0].as_py(), np.int32)), *map(pa.array, (counts.a, counts.b, m))], ["block", "a", "b", "m"])


def _weighed(block: pa.Table, n: int, max_df: float, known=None):
    """ids; a, b, df; text, n-gram and weight of all n-grams that count (and that ``known``, a function of a and b, is true for) of a block
    of texts as vectors of length 1, weighted as in ``vectors``. Rows of block: texts (id, m, text); and for n-grams that other
    blocks have too their df (a, b, df). N-grams without such a row are in texts of this block alone, which knows their df."""
    texts, rows = block.filter(pc.field("text").is_valid()), block.filter(~pc.field("text").is_valid())
    counts = _Counts(texts.column("text").to_pylist())
    df = counts.texts_with(texts.column("m").to_numpy())
    a, b, shared = (rows.column(c).to_numpy() for c in ("a", "b", "df"))
    df[_same(np.concatenate([counts.a, a]), np.concatenate([counts.b, b]))[len(df) :]] = shared
    idf = np.where(df <= max_df * n, np.log((1.0 + n) / (1 + df)) + 1, 0.0)
    kept = idf > 0 if known is None else (idf > 0) & known(counts.a, counts.b)
    norm, found = np.zeros(texts.num_rows), [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
    for t, g, tf in counts.cells():
        w = (1 + np.log(tf)) * idf[g]
        norm += np.bincount(t, w * w, len(norm))
        own = kept[g]
        found.append((t[own].astype(np.int32), g[own].astype(np.int32), w[own]))
    t, g, w = map(np.concatenate, zip(*found, strict=True))
    w /= np.sqrt(norm)[t]
    return texts.column("id").combine_chunks(), counts.a, counts.b, df, t, g, w


def _packing(n: int, max_df: float):
    """The texts of a block of ``_weighed`` as a row each: o_block, id, n-grams (a, b) and weights; texts without any are left out."""

    def run(block: pa.Table) -> pa.Table:
        ids, a, b, _, t, g, w = _weighed(block, n, max_df)
        own, starts = np.unique(t, return_index=True)
        at = pa.array(np.append(starts, len(t)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (a[g], b[g], w)]
        return pa.table([pa.array(np.full(len(own), block.column("block")[0].as_py(), np.int32)), ids.take(pa.array(own)), *lists], ["o_block", "id", "a", "b", "w"])

    return run


def _best_of(n: int, max_df: float):
    """o, t, s, r: of a block of ``_weighed`` and one of ``_packing``, for each other text the greatest cosine s, and the least id of
    training texts alike to 9 digits, r."""

    def run(train: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        if train.num_rows and other.num_rows:
            lists = [other.column(c).combine_chunks() for c in ("a", "b", "w")]
            at = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            o_a, o_b, o_w = (x.flatten().to_numpy() for x in lists)
            o_g = None

            def known(a, b):
                nonlocal o_g
                o_g = _same(np.concatenate([a, o_a]), np.concatenate([b, o_b]))[len(a) :]
                return np.isin(np.arange(len(a)), o_g)

            ids, _, _, _, t, g, w = _weighed(train, n, max_df, known)
            t_ids, o_ids = ids.to_numpy(zero_copy_only=False), other.column("id").to_numpy()
            order = np.argsort(g)
            t, g, w = t[order], g[order], w[order]
            starts, ends = np.searchsorted(g, o_g), np.searchsorted(g, o_g, "right")
            for o in range(len(o_ids)):
                own = slice(at[o], at[o + 1])
                k = ends[own] - starts[own]
                if k.sum():
                    cells = np.repeat(starts[own] - np.cumsum(k) + k, k) + np.arange(k.sum())  # the postings of all its n-grams
                    s = np.bincount(t[cells], w[cells] * np.repeat(o_w[own], k), len(t_ids))
                    r = np.floor(s * 1e9 + 0.5)
                    top = r.max()
                    found.append((o_ids[o], t_ids[r == top].min(), s.max(), top))
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        kinds = other.schema.field("id").type, train.schema.field("id").type, pa.float64(), pa.float64()
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["o", "t", "s", "r"])

    return run


def _distinct(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(side, id, text, digest) of training texts (side 0) and others (side 1), null texts empty; (side, digest, id, m, size): the least
    id, the number and the length of equal texts of a side; and these texts (side, id, text, m, size)."""
    digest = F.sha2("text", 256)
    of = lambda d, side: d.select(F.lit(side).alias("side"), "id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest)
    both = of(train, 0).unionByName(of(other, 1))
    firsts = cut(both.groupBy("side", "digest").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.max(F.length("text")).alias("size")))
    return both, firsts, both.drop("digest").join(firsts.drop("digest"), ["side", "id"])


def _rare(n: int, max_df: float, least: float, t_blocks: int):
    """side, id, h, w, rest: of each text of a block of ``_weighed`` its n-grams, rare ones first, up to where what is left is shorter than
    ``least``: 32 bits of each (h) and its weight; rest: the length of what is left."""

    def run(block: pa.Table) -> pa.Table:
        ids, a, b, df, t, g, w = _weighed(block, n, max_df)
        place = np.empty(len(df), np.int64)
        place[np.lexsort((b, a, df))] = np.arange(len(df))
        order = np.argsort(t * max(1, len(df)) + place[g])
        t, g, w = t[order].astype(np.int64), g[order], w[order]
        texts, starts = np.unique(t, return_index=True)
        behind = np.cumsum(w[::-1] ** 2)[::-1]
        size = np.diff(np.append(starts, len(t)))
        behind = np.sqrt(np.maximum(0, behind - np.repeat(np.append(behind, 0.0)[np.append(starts, len(t))[1:]], size)))
        met = behind >= least - _SLACK
        rest = np.maximum.reduceat(np.where(met, 0.0, behind), starts) if len(t) else np.zeros(0)
        at = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(met, starts, dtype=np.int64))]) if len(t) else np.zeros(1, int), pa.int32())
        h = ((a * 0x9E3779B1 ^ b * 0x85EBCA77) * 0x27D4EB2F165667C5 >> 32).astype(np.int32)[g[met]]
        side = pa.array(np.full(len(texts), int(block.column("block")[0].as_py() >= t_blocks), np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (h, w[met].astype(np.float32))]
        return pa.table([side, ids.take(pa.array(texts)), *lists, pa.array(rest)], ["side", "id", "h", "w", "rest"])

    return run


def _may_be_near(least: float):
    """o, t, s: pairs of an other text and a training text, both rows of ``_rare``, whose cosine may reach ``least``, and s, the product of
    what they share of their rare n-grams. What it leaves out is at most the longer rest; n-grams with equal bits can only add to s."""

    def run(train: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        if train.num_rows and other.num_rows:
            (t_at, t_h, t_w), (o_at, o_h, o_w) = ((np.append(0, np.cumsum(pc.list_value_length(d.column("h")).to_numpy())), *(pc.list_flatten(d.column(c)).to_numpy() for c in ("h", "w"))) for d in (train, other))
            t_ids, o_ids = (d.column("id").to_numpy() for d in (train, other))
            t_rest, o_rest = (d.column("rest").to_numpy() for d in (train, other))
            order = np.argsort(t_h, kind="stable")
            t = np.repeat(np.arange(len(t_ids)), np.diff(t_at))[order]
            t_h, t_w = t_h[order], t_w[order]
            starts, ends = np.searchsorted(t_h, o_h), np.searchsorted(t_h, o_h, "right")
            for o in range(len(o_ids)):
                own = slice(o_at[o], o_at[o + 1])
                k = ends[own] - starts[own]
                cells = np.repeat(starts[own] - np.cumsum(k) + k, k) + np.arange(k.sum())  # the postings of all its rare n-grams
                s = np.bincount(t[cells], t_w[cells].astype(float) * np.repeat(o_w[own], k), len(t_ids))
                fit = np.flatnonzero(s + np.maximum(t_rest, o_rest[o]) >= least - 1e-5)
                found.append((np.full(len(fit), o), fit, s[fit]))
        o, t, s = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([other.column("id").take(pa.array(o)), train.column("id").take(pa.array(t)), pa.array(s)], ["o", "t", "s"])

    return run


def _whole(n: int, max_df: float, t_blocks: int):
    """side, id, a, b, w: the whole vectors of the texts of a block that are ``wanted``."""

    def run(block: pa.Table) -> pa.Table:
        ids, a, b, _, t, g, w = _weighed(block, n, max_df)
        flags = pc.fill_null(block.filter(pc.field("text").is_valid()).column("wanted"), False).to_numpy()
        own = flags[t]
        t, g, w = t[own], g[own], w[own]
        texts, starts = np.unique(t, return_index=True)
        at = pa.array(np.append(starts, len(t)), pa.int32())
        side = pa.array(np.full(len(texts), int(block.column("block")[0].as_py() >= t_blocks), np.int32))
        return pa.table([side, ids.take(pa.array(texts)), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in (a[g], b[g], w))], ["side", "id", "a", "b", "w"])

    return run


def _products(batches):
    """o; a, b, w of either text of a pair -> o, s: their cosine."""
    for batch in batches:
        out = []
        for x_a, x_b, x_w, y_a, y_b, y_w in zip(*(batch.column(c) for c in ("x_a", "x_b", "x_w", "y_a", "y_b", "y_w")), strict=True):
            x_a, x_b, x_w, y_a, y_b, y_w = (c.values.to_numpy() for c in (x_a, x_b, x_w, y_a, y_b, y_w))
            g = _same(np.concatenate([x_a, y_a]), np.concatenate([x_b, y_b]))
            w = np.bincount(g[: len(x_w)], x_w, g.max(initial=0) + 1)
            out.append(float(w[g[len(x_w) :]] @ y_w))
        yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array(out, pa.float64())], ["o", "s"])


def near(train: DataFrame, other: DataFrame, least: float, max_df: float = 0.2) -> DataFrame:
    """id of each other text that has a training text with a cosine of at least ``least`` (over 0): those whose ``max_similarity`` is
    that high. Both: id (distinct), text; null texts are empty.

    Tasks count the n-grams of blocks of texts as in ``max_similarity``; only the rare n-grams of each text leave them. From these, tasks
    find the few pairs that can be as near (``_may_be_near``), and whole vectors are made for these pairs alone: first for each text's most
    promising one, then for all others of texts that are not settled by it.
    """
    both, firsts, n, sizes, t_blocks, rows = _dealt(train, other)
    kind = both.schema["id"].dataType.simpleString()
    rare = cut(rows.groupBy("block").applyInArrow(_rare(n, max_df, _MET * least, t_blocks), f"side int, id {kind}, h array<int>, w array<float>, rest double"))
    t_all, o_all = (max(1, -(-size // (8 * BLOCK))) for size in sizes)
    each = lambda k: F.explode(F.array(*map(F.lit, range(k))))
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    t_rows = rare.filter("side = 0").withColumn("t_block", deal(t_all)).withColumn("o_block", each(o_all)).groupBy("t_block", "o_block")
    o_rows = rare.filter("side = 1").withColumn("o_block", deal(o_all)).withColumn("t_block", each(t_all)).groupBy("t_block", "o_block")
    pairs = cut(t_rows.cogroup(o_rows).applyInArrow(_may_be_near(least), f"o {kind}, t {kind}, s double"))

    def settled(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.lit(1).alias("side"), F.col("o").alias("id")).unionByName(pairs.select(F.lit(0).alias("side"), F.col("t").alias("id"))).distinct()
        flagged = rows.withColumn("side", F.when(F.col("block") >= t_blocks, 1).otherwise(0)).join(wanted.withColumn("wanted", F.lit(True)), ["side", "id"], "left")
        found = flagged.drop("side").groupBy("block").applyInArrow(_whole(n, max_df, t_blocks), f"side int, id {kind}, a array<long>, b array<long>, w array<double>")
        found = cut(found)
        of = lambda side, key, name: found.filter(F.col("side") == side).select(F.col("id").alias(key), *(F.col(c).alias(f"{name}_{c}") for c in "abw"))
        met = pairs.select("o", "t").join(of(1, "o", "x"), "o").join(of(0, "t", "y"), "t").drop("t")
        near = cut(met.mapInArrow(_products, f"o {kind}, s double").filter(F.col("s") >= least).select("o").distinct())
        discard(found)
        return near

    first = settled(pairs.groupBy("o").agg(F.max_by("t", "s").alias("t")))
    others = cut(pairs.join(first, "o", "left_anti"))
    found = first.unionByName(settled(others)).select(F.col("o").alias("id"))
    discard(rare, pairs)
    alike = firsts.filter("side = 1").join(found, "id").select("digest")
    return both.filter("side = 1").join(alike, "digest").select("id")


def _dealt(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, int, tuple[int, int], int, DataFrame]:
    """both and firsts of ``_distinct``; the number of all texts; the characters of either side's; the number of blocks of training texts, which
    come first; and rows of ``_weighed`` by block."""
    both, firsts, texts = _distinct(train, other)
    sums = {r.side: (r.m, r.size) for r in firsts.groupBy("side").agg(F.sum("m").alias("m"), F.sum("size").alias("size")).collect()}
    sizes = tuple(sums.get(side, (0, 0))[1] for side in (0, 1))
    t_blocks, o_blocks = (max(1, -(-size // most)) for size, most in zip(sizes, (BLOCK, BLOCK // 2), strict=True))
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    block = F.when(F.col("side") == 0, deal(t_blocks)).otherwise(t_blocks + deal(o_blocks)).cast("int")  # those of others come last
    texts = cut(texts.select(block.alias("block"), "id", "m", F.lower("text").cast("binary").alias("text")))
    counts = texts.select("block", "m", "text").groupBy("block").applyInArrow(_block_counts, "block int, a long, b long, m long")
    shared = counts.withColumn("df", F.sum("m").over(W.partitionBy("a", "b"))).filter("df <> m").drop("m")
    return both, firsts, sum(m for m, _ in sums.values()), sizes, t_blocks, texts.unionByName(cut(shared), allowMissingColumns=True)


def max_similarity(train: DataFrame, other: DataFrame, max_df: float = 0.2) -> DataFrame:
    """id, best, max_sim: each other text's most similar training text (the least id of those alike to 9 digits; null for
    none) and their cosine, unrounded. Both: id (distinct), text; null texts are empty.

    Texts are vectors as in ``vectors``, over both tables together. Equal texts are compared once. Texts are dealt to blocks, and a task
    counts the n-grams of one: a row for each n-gram and block tells how many texts have it, and only the sums of those go back.
    Then blocks of training texts meet blocks of others, and only the best of a block for each other text leaves them: neither the
    n-grams of training texts nor pairs are ever rows.
    """
    both, firsts, n, sizes, t_blocks, rows = _dealt(train, other)
    o_blocks = max(1, -(-sizes[1] // (BLOCK // 2)))
    kinds = [d.schema["id"].dataType.simpleString() for d in (other, train)]
    packed = f"o_block int, id {kinds[0]}, a array<long>, b array<long>, w array<double>"
    o = cut(rows.filter(F.col("block") >= t_blocks).groupBy("block").applyInArrow(_packing(n, max_df), packed))
    each = lambda blocks: F.explode(F.array(*map(F.lit, blocks)))
    t_all = rows.filter(F.col("block") < t_blocks).withColumn("o_block", each(range(t_blocks, t_blocks + o_blocks)))
    o_all = o.withColumn("block", each(range(t_blocks))).groupBy("block", "o_block")
    found = t_all.groupBy("block", "o_block").cogroup(o_all).applyInArrow(_best_of(n, max_df), f"o {kinds[0]}, t {kinds[1]}, s double, r double")
    best = found.groupBy("o").agg(F.max("s").alias("s"), F.max_by("t", F.struct("r", (-F.col("t")).alias("i"))).alias("best"))
    found = firsts.filter("side = 1").select("digest", F.col("id").alias("o")).join(best, "o", "left")
    return both.filter("side = 1").select("id", "digest").join(found, "digest").select("id", "best", F.coalesce("s", F.lit(0.0)).alias("max_sim"))

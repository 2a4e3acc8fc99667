"""LM scoring with a Brown class-based bigram model.

Training counts every word of the training documents. Words are put into ``classes`` classes by exchange clustering, in
two steps. The ``clustered`` most frequent words are exchanged on the driver: each in turn moves to the class that raises
the likelihood of the class bigrams most; its input is a matrix of at most (clustered + suffixes) ** 2 cells, whatever the
corpus. Then, in ``rounds`` passes over the corpus, all other words of the ``head`` are counted against the classes of their
neighbours, and each goes to the class that these make most likely, in as many tasks as there are. The head are the
words that each task can hold, by falling count; rarer words, and those that training doesn't have, belong to one of
``suffixes`` further classes by a hash of their last three bytes, and take part in the class bigrams there.

P(word | previous) = mix * P(class | class of previous) * P(word | class) + (1 - mix) * P(word), where P(word | class) and
P(word) add one to counts and keep a share for unknown words. Both have the word's count plus one as a factor, so a text's
score is a sum over its class pairs, known to the scan, plus the sum of log10(count + 1). Counts of the head
go to the scan; those of other words are joined.

Texts are cut into words twice: to count them, and to write them down as numbers of the head, which all passes read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import blocks, table, text_bytes, with_row_id, written

#: Ends each text and stands before each first word; white space is in no word.
END = b"\n"
HELD_OUT_OF, HELD_OUT = 7, 2
_FLUSH = 400_000


@dataclass(frozen=True)
class Settings:
    clustered: int = 1024
    classes: int = 64
    suffixes: int = 64
    head: int = 131_072
    sweeps: int = 3
    rounds: int = 2
    mix: float = 0.98
    back_off: float = 20.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == HELD_OUT


def suffix_class(word: bytes, suffixes: int) -> int:
    return zlib.crc32(word[-3:]) % suffixes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> word, n; partial counts of a task, handed on when they grow."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in text_bytes(batch.column(0)):
            counts.update(text.lower().split())
            counts[END] += 1
            if len(counts) > _FLUSH:
                yield out(counts)
                counts.clear()
    if counts:
        yield out(counts)


class _Ids(dict):
    """Word -> its number in the head; other words, unstored, have -1 less the number of their suffix class."""

    def __init__(self, words: list[bytes], suffixes: int):
        super().__init__((w, i) for i, w in enumerate(words))
        self.suffixes = suffixes

    def __missing__(self, word: bytes) -> int:
        return -1 - suffix_class(word, self.suffixes)


def _encode(shared, suffixes: int, carried: int):
    """Carried columns and text -> carried columns, n_tokens, ids (a 32-bit number for each word and the end), and the words
    outside the head with their numbers in the text."""
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(shared.value, suffixes)
        for batch in batches:
            texts = text_bytes(batch.column(carried))
            for a, b in blocks(map(len, texts), 4_000_000):
                sizes, coded, tails = [], [], []
                for text in texts[a:b]:
                    words = text.lower().split()
                    words.append(END)
                    number = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                    sizes.append(len(words))
                    coded.append(number.astype("<i4").tobytes())
                    tails.append([{"word": w, "n": n} for w, n in Counter([words[i] for i in np.flatnonzero(number < 0).tolist()]).items()])
                cols = [*(batch.column(i)[a:b] for i in range(carried)), pa.array(sizes, pa.int64()), pa.array(coded, pa.binary()), pa.array(tails, tail_type)]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:carried], "n_tokens", "ids", "tail"])

    return run


def _coded(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of about a million words, with the numbers of their words in one array."""
    for batch in batches:
        raw = batch.column(at).to_pylist()
        for a, b in blocks(map(len, raw), 4_000_000):
            yield batch.slice(a, b - a), np.frombuffer(b"".join(raw[a:b]), "<i4")


def _before(kinds: np.ndarray, end: int) -> np.ndarray:
    """What stands before each word: before a text's first, the end of the text before, or of none."""
    return np.concatenate([[end], kinds[:-1]])


def _pairs(shared, size: int):
    """ids -> pairs of the places that words have in a table, and how often they follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        total = np.zeros(size * size, np.int64)
        for _, ids in _coded(batches):
            now = place[ids]
            pair, n = np.unique(_before(now, place[0]) * size + now, return_counts=True)
            total[pair] += n
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return run


def _neighbours(shared, kinds: int, fixed: int, most: int = 4_000_000):
    """ids -> for each word of the head from ``fixed`` on, the classes before and after it: key (word, side, class), n. Keys
    of several slices are counted together before they go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = shared.value

        def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        keys, held = [], 0
        for _, ids in _coded(batches):
            kind = kind_of[ids]
            at = np.flatnonzero(ids >= fixed)  # never the end of a text, so a word follows
            wide = ids[at].astype(np.int64) * 2 * kinds
            keys += [wide + _before(kind, kind_of[0])[at], wide + kinds + kind[at + 1]]
            held += 2 * len(at)
            if held > most:
                yield counted(keys)
                keys, held = [], 0
        if held:
            yield counted(keys)

    return run


def _best(shared, kinds: int):
    """key, n, all of a word in one task -> word, kind: the class that its neighbours make most likely. The task holds the
    counts of its words, a share of the head's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, cost = shared.value  # by side and class of the neighbour, then class; by class
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, row = np.unique(key // (2 * kinds), return_inverse=True)
        for a in range(0, len(words), 8192):
            mine = (row >= a) & (row < a + 8192)
            size = min(8192, len(words) - a)
            place = (row[mine] - a) * 2 * kinds + key[mine] % (2 * kinds)
            counts = np.bincount(place, n[mine], minlength=size * 2 * kinds).reshape(size, 2 * kinds)
            score = counts @ weight - counts[:, :kinds].sum(1)[:, None] * cost[None, :]
            out = [pa.array(words[a : a + size], pa.int32()), pa.array(score.argmax(1), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["word", "kind"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(matrix: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """The class of each cell. The first ``movable`` cells are exchanged among ``classes`` classes; each further cell is
    a class of its own. Raises sum n(c, d) log n(c, d) - sum n(c, .) log n(c, .) - sum n(., d) log n(., d)."""
    size = len(matrix)
    kinds = classes + size - movable
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)])
    one_hot = np.zeros((size, kinds))
    one_hot[np.arange(size), of] = 1
    left, right = one_hot.T @ matrix, matrix @ one_hot  # by class of the word before; of the word after
    pairs = one_hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            old, own = of[w], matrix[w, w]
            to, frm = right[w].copy(), left[:, w].copy()  # w before a class; a class before w
            to[old] -= own
            frm[old] -= own
            pairs[old] -= to
            pairs[:, old] -= frm
            pairs[old, old] -= own
            rows, cols = pairs.sum(1), pairs.sum(0)
            base = pairs[:classes]
            gain = (_xlogx(base + to) - _xlogx(base)).sum(1)
            base = pairs[:, :classes]
            gain += (_xlogx(base + frm[:, None]) - _xlogx(base)).sum(0)
            at = np.arange(classes)
            both = pairs[at, at]
            gain += _xlogx(both + to[at] + frm[at] + own) - _xlogx(both + to[at]) - _xlogx(both + frm[at]) + _xlogx(both)
            row, col = to.sum() + own, frm.sum() + own
            gain -= _xlogx(rows[at] + row) - _xlogx(rows[at]) + _xlogx(cols[at] + col) - _xlogx(cols[at])
            new = int(np.argmax(gain))
            pairs[new] += to
            pairs[:, new] += frm
            pairs[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                left[old] -= matrix[w]
                left[new] += matrix[w]
                right[:, old] -= matrix[:, w]
                right[:, new] += matrix[:, w]
        if not moved:
            break
    return of


@dataclass
class Vocabulary:
    """counts: a table of word, n, of all words. words: the head, the end of a text first, then by falling count;
    head_counts: theirs. by_suffix: tokens and types of each suffix class, the head's included."""

    counts: DataFrame
    words: list[bytes]
    head_counts: np.ndarray
    by_suffix: dict[int, tuple[int, int]]
    tokens: int
    types: int


@dataclass
class Model:
    """kind_of: the class of each word of the head, then of the suffixes from the last to the first, so that numbers below
    0 find theirs. step: log10 of what a class pair and one count contribute."""

    settings: Settings
    vocabulary: Vocabulary
    kind_of: np.ndarray
    step: np.ndarray


def vocabulary(documents: DataFrame, settings: Settings = Settings()) -> Vocabulary:
    """Count all words of the texts."""
    s = settings
    texts = documents.select(F.col("text").cast("string").alias("text"))
    counts = written(
        texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    suffix = F.crc32(F.substring("word", -3, 3)) % s.suffixes
    by_suffix = {
        r.k: (r.n, r.v)
        for r in counts.groupBy(suffix.cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    }
    tokens, types = sum(n for n, _ in by_suffix.values()), sum(v for _, v in by_suffix.values())
    # the head: the words of as many classes of frequency, of 1/64 of a natural logarithm each, as fit into s.head
    band = F.floor(F.log("n") * 64)
    bands = sorted(counts.groupBy(band.alias("b")).agg(F.count("*").alias("v")).collect(), reverse=True)
    fits = [r.b for r, total in zip(bands, np.cumsum([r.v for r in bands]), strict=True) if total <= s.head]
    top = {bytes(r.word): r.n for r in counts.filter(band >= min(fits, default=1 << 40)).collect()}
    if END not in top:  # nothing learnt, or fewer texts than the head's words
        top[END] = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    words = sorted(top, key=lambda w: (w != END, -top[w], w))
    return Vocabulary(counts, words, np.array([top[w] for w in words], np.int64), by_suffix, tokens, types)


def encode(documents: DataFrame, known: Vocabulary, settings: Settings = Settings()) -> DataFrame:
    """row_id, and all columns of ``documents`` but text, n_tokens, ids, tail: its words by their numbers in the head."""
    shared = documents.sparkSession.sparkContext.broadcast(known.words)
    rest = [f"`{c}`" for c in documents.columns if c != "text"]
    rows = with_row_id(documents.select(*rest, F.col("text").cast("string").alias("text")))
    rows = rows.select("row_id", *rest, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    made = f"{kinds}, n_tokens long, ids binary, tail array<struct<word:binary,n:long>>"
    return written(rows.mapInArrow(_encode(shared, settings.suffixes, len(rest) + 1), made), "encoded")


def _follow(encoded: DataFrame, place: np.ndarray, size: int) -> np.ndarray:
    """How often a place follows another, size by size; the driver gets at most that many rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(place)
    found = encoded.select("ids").mapInArrow(_pairs(shared, size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def train(encoded: DataFrame, known: Vocabulary, settings: Settings = Settings()) -> Model:
    """Learn classes and class bigrams from ``encoded`` texts, those that the vocabulary was counted on. An empty table
    gives a model in which every word is unknown."""
    s, context = settings, encoded.sparkSession.sparkContext
    suffix = np.array([suffix_class(w, s.suffixes) for w in known.words], np.int64)
    fixed, kinds = min(len(known.words), s.clustered + 1), s.classes + s.suffixes
    others = np.arange(s.suffixes)[::-1]
    cells = np.concatenate([np.where(np.arange(len(suffix)) < fixed, np.arange(len(suffix)), fixed + suffix), fixed + others])
    of = exchange(_follow(encoded, cells, fixed + s.suffixes), fixed, s.classes, s.sweeps)
    kind_of = np.concatenate([of[:fixed], s.classes + suffix[fixed:], s.classes + others])
    pairs = _follow(encoded, kind_of, kinds)
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(s.rounds if fixed < len(known.words) else 0):
        after = np.log((pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * kinds))
        mass = np.bincount(kind_of[: len(suffix)], known.head_counts, minlength=kinds)[: s.classes]
        # a word's left neighbour d gives log P(k | d), its right one log P(d | k)
        weight = np.concatenate([after[:, : s.classes], after[: s.classes].T])
        counts = encoded.select("ids").mapInArrow(_neighbours(context.broadcast(kind_of), kinds, fixed), "key long, n long")
        counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
        counts = counts.repartition(n, F.floor(F.col("key") / (2 * kinds)))
        best = counts.mapInArrow(_best(context.broadcast((weight, np.log(mass + 1))), kinds), "word int, kind int").toArrow()
        kind_of[best["word"].to_numpy()] = best["kind"].to_numpy()  # at most a row for each word of the head
        pairs = _follow(encoded, kind_of, kinds)
    return Model(s, known, kind_of, _steps(known, s, kind_of, pairs, suffix))


def _steps(known: Vocabulary, s: Settings, kind_of: np.ndarray, pairs: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    mass, types = np.zeros(s.classes + s.suffixes), np.zeros(s.classes + s.suffixes)
    for k, (n, v) in known.by_suffix.items():
        mass[s.classes + k], types[s.classes + k] = n, v
    seen = (known.head_counts > 0).astype(np.int64)
    size = len(mass)
    mass -= np.bincount(s.classes + suffix, known.head_counts, minlength=size)
    types -= np.bincount(s.classes + suffix, seen, minlength=size)
    mass += np.bincount(kind_of[: len(suffix)], known.head_counts, minlength=size)
    types += np.bincount(kind_of[: len(suffix)], np.maximum(seen, 1), minlength=size)
    types[s.classes :] += 1  # the unknown word of each suffix
    share = (mass + 1) / (mass + 1).sum()
    after = (pairs + s.back_off * share) / (pairs.sum(1, keepdims=True) + s.back_off)
    emit = 1 / np.maximum(mass + types, 1)
    return np.log10(s.mix * after * emit + (1 - s.mix) / (known.tokens + known.types + 1))


def _scores(shared):
    """ids first, then carried columns -> these, n_known, and sums over a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_counts, kind_of, step = shared.value
        logs = np.concatenate([np.log10(head_counts + 1.0), np.zeros(len(kind_of) - len(head_counts))])
        known = np.concatenate([(head_counts > 0).astype(np.int64), np.zeros(len(kind_of) - len(head_counts), np.int64)])
        for batch, ids in _coded(batches):
            sizes = np.array([len(x) // 4 for x in batch.column(0).to_pylist()])
            starts = np.cumsum(sizes) - sizes
            kind = kind_of[ids]
            own = step[_before(kind, kind_of[0]), kind]
            sums = [pa.array(np.add.reduceat(x, starts)) for x in (known[ids], logs[ids], own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *sums], [*batch.schema.names[1:], "n_known", "logs", "steps"])

    return run


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """The rows of ``encoded`` without ids and tail, and n_known, train_tokens, base_score, score, perplexity.

    Null and empty texts are their end token alone; repeated rows are scored each.
    """
    known = model.vocabulary
    shared = encoded.sparkSession.sparkContext.broadcast((known.head_counts, model.kind_of, model.step))
    rest = [f for f in encoded.schema if f.name not in ("ids", "tail")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    names = [f"`{f.name}`" for f in rest]
    scanned = encoded.select("ids", *names).mapInArrow(_scores(shared), f"{kinds}, n_known long, logs double, steps double")
    tail = (
        encoded.select("row_id", F.explode("tail").alias("t"))
        .select("row_id", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
        .join(known.counts, "word")
        .groupBy("row_id")
        .agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_logs"))
    )
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0))
    flat = float(np.log10(known.tokens + known.types + 1))
    total = logs + F.col("steps")
    return scanned.join(tail, "row_id", "left").select(
        *names,
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (logs - F.lit(flat) * F.col("n_tokens")).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    known = vocabulary(docs.filter(~F.col("held_out")))
    coded = encode(docs, known)
    found = score(coded, train(coded.filter(~F.col("held_out")), known))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")

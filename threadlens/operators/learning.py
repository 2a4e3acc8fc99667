"""Learned baselines: TF-IDF over words and characters with logistic regression."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.sources.tables import chunk_cells, cut, discard, numbered, packed
from threadlens.sources.tables import summed as _summed

#: Texts that must hold a feature, by block.
LEAST_TEXTS = {"word": 1, "char": 2}
#: Directions that a step combines, rows of a part of a sum, the share of the loss that the bound on what is left to gain stops at; cells read at once.
DIRECTIONS, PART, TOLERANCE = 10, 8192, 1e-9
CELLS = 1 << 20


@dataclass
class Model:
    """weights: block, term, idf, w (a number for each column); size: its rows; labels: by class number; intercepts: by column. Two
    labels have one column, that of the second; more have one each."""

    weights: DataFrame
    size: int
    labels: list[str]
    intercepts: list[float]

    @property
    def vocabulary(self) -> DataFrame:
        """block, term, idf, i."""
        return numbered(self.weights.select("block", "term", "idf"), ["block", "term"])


def _index(frames):
    """id, words, tokens -> block, term, r, tf: for each term of a batch the ids of the texts that have it, and how often."""
    for frame in frames:
        found = {"word": defaultdict(lambda: ([], [])), "char": defaultdict(lambda: ([], []))}
        parts: dict[str, list[str]] = {}
        for key, words, tokens in zip(*(frame.column(c).to_pylist() for c in ("id", "words", "tokens")), strict=True):
            counts = {"word": Counter(words or []), "char": {}}
            counts["word"].update(" ".join(p) for p in zip(words or [], (words or [])[1:], strict=False))
            char = counts["char"]
            for token, n in Counter(tokens or []).items():
                if (own := parts.get(token)) is None:
                    w = f" {token} "
                    own = parts[token] = [w[i : i + k] for k in range(3, min(5, max(3, len(token) + 2)) + 1) for i in range(max(1, len(w) - k + 1))]
                for g in own:
                    char[g] = char.get(g, 0) + n
            for block, each in counts.items():
                index = found[block]
                for term, n in each.items():
                    ids, often = index[term]
                    ids.append(key)
                    often.append(n)
        for block, index in found.items():
            terms = list(index)
            for i in range(0, len(terms), 1 << 16):
                some = terms[i : i + (1 << 16)]
                ends = np.cumsum([0, *(len(index[t][0]) for t in some)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array([x for t in some for x in index[t][j]], kind)) for j, kind in enumerate((frame.schema.field("id").type, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), pa.array(some, pa.string()), *lists], ["block", "term", "r", "tf"])


def features(texts: DataFrame) -> DataFrame:
    """block, term, r, tf of texts (id, text): words of two and more characters and pairs of neighbouring ones (block word), and n-grams of
    3 to 5 characters within words, as in ``retrieval.grams`` (block char), each with ids of texts that have it (r) and how often (tf). A
    term has several rows, one for each batch of texts. Lower case; a null text has none."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{2,}"), F.lit(0))
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", words.alias("words"), tokens.alias("tokens")).mapInArrow(_index, f"block string, term string, r array<{kind}>, tf array<int>")


def _cells(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of features over n texts: their starts and sizes, and of all cells the text, behind n others for those of characters, and 1 +
    ln(count)."""
    lists = [batch.column(c) for c in ("r", "tf")]
    starts = lists[0].offsets.to_numpy()
    sizes = np.diff(starts)
    r, tf = (x.flatten().to_numpy() for x in lists)
    char = np.where(batch.column("block").to_numpy(zero_copy_only=False) == "char", n, 0)
    return starts[:-1] - starts[0], sizes, r + np.repeat(char, sizes), (1 + np.log(np.arange(1, tf.max() + 1)))[tf - 1]


def _packed(batches):
    """Batches of about CELLS cells, so that what costs by batch is small."""
    held, cells = [], 0
    for batch in batches:
        held.append(batch)
        cells += len(batch.column("r").flatten())
        if cells >= CELLS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, cells = [], 0
    if cells:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _chunking(n: int):
    """Rows of features over n texts -> idf, size, r, tf: chunks of ``chunk_cells``, texts behind n others for those of characters."""

    def run(batches):
        for batch in _packed(batches):
            lists = [batch.column(c) for c in ("r", "tf")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            r, tf = (x.flatten().to_numpy() for x in lists)
            char = np.where(batch.column("block").to_numpy(zero_copy_only=False) == "char", n, 0)
            row = [batch.column("idf").to_numpy().tobytes(), packed(sizes), packed(r + np.repeat(char, sizes)), packed(tf)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["idf", "size", "r", "tf"])

    return run


def _chances(margins: np.ndarray, two: bool) -> np.ndarray:
    """Chances by column of rows' margins; the first of two labels has margin 0 and no column."""
    z = np.concatenate([np.zeros((len(margins), 1)), margins], 1) if two else margins
    e = np.exp(z - z.max(1, keepdims=True))
    return (e / e.sum(1, keepdims=True))[:, int(two) :]


def _loss(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, two: bool) -> float:
    z = np.concatenate([np.zeros((len(margins), 1)), margins], 1) if two else margins
    top = z.max(1)
    return float(weight @ (top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(y)), y]))


def _combine(images: list[np.ndarray], gram: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """The best combination of directions, by their images and their products, and intercepts, by Newton steps from the first direction
    alone; with its loss."""
    t, k = len(images), len(b)
    ones = np.eye(k + two)[y][:, int(two) :]
    c = np.eye(t)[0]
    at = lambda c, b: sum(x * m for x, m in zip(c, images, strict=True)) + b
    value = lambda m, c: _loss(m, y, weight, two) + 0.5 * c @ gram @ c
    m = at(c, b)
    now = value(m, c)
    for _ in range(50):
        p = _chances(m, two)
        error = weight[:, None] * (p - ones)
        slope = np.concatenate([[np.vdot(error, x) for x in images] + gram @ c, error.sum(0)])
        curve = np.zeros((t + k, t + k))
        curve[:t, :t] = gram
        for i in range(0, len(y), PART):  # rows at a time, as there are t + k numbers for each row and column
            s = slice(i, i + PART)
            q = p[s]
            z = np.stack([x[s] for x in images] + [np.broadcast_to(e, q.shape) for e in np.eye(k)])
            pz = q * z
            bent = weight[s][:, None] * (pz - q * pz.sum(2, keepdims=True))
            curve += z.reshape(t + k, -1) @ bent.reshape(t + k, -1).T
        size = np.sqrt(np.maximum(np.diag(curve), 1e-300))  # directions shrink, so they are brought to one size
        step = -np.linalg.lstsq(curve / size[:, None] / size, slope / size, rcond=1e-13)[0] / size
        gain, far = -(slope @ step), 1.0
        while far > 1e-6:
            after = at(c + far * step[:t], b + far * step[t:])
            if (then := value(after, c + far * step[:t])) <= now - 1e-4 * far * gain:
                break
            far /= 2
        else:
            break
        c, b, m, won, now = c + far * step[:t], b + far * step[t:], after, now - then, then
        if won <= 1e-14 * abs(now):
            break
    return c, b, now


def _minimise(product, y: np.ndarray, weight: np.ndarray, labels: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): weights of features are the features' transposed table times a, and b the intercepts, at the least of the weighted loss and
    half the squared weights. product: the features' table times its transpose, times a table of numbers by row and column.

    Every gradient is the transposed table times the rows' errors and a, so steps need no weights, and one product each: the loss of any
    combination of known directions follows from their images. A step takes the best combination of the last DIRECTIONS. The squared gradient
    bounds twice what is left to gain.
    """
    two = labels == 2
    ones = np.eye(labels)[y][:, int(two) :]
    a, image, b = np.zeros_like(ones), np.zeros_like(ones), np.zeros(ones.shape[1])
    _, b, _ = _combine([image], np.zeros((1, 1)), b, y, weight, two)
    ways: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d = weight[:, None] * (_chances(image + b, two) - ones) + a
        own = product(d)
        left = np.vdot(d, own)
        size = np.sqrt(max(left, 1e-300))
        ways = [(d / size, own / size), *ways][:DIRECTIONS]
        all_ways = [(a, image), *ways]
        gram = np.array([[np.vdot(x, i) for _, i in all_ways] for x, _ in all_ways])
        c, b, loss = _combine([i for _, i in all_ways], (gram + gram.T) / 2, b, y, weight, two)
        new, new_image = (sum(x * w[j] for x, w in zip(c, all_ways, strict=True)) for j in (0, 1))
        ways = [*ways[:1], (new - a, new_image - image), *ways[1:]][:DIRECTIONS] if len(ways) > 1 else ways
        a, image = new, new_image
        if left / 2 <= TOLERANCE * loss:
            break
    return a, b


def fit(train: DataFrame, rounds: int = 200) -> Model:
    """Train on (id, text, label), ids distinct, labels not null: smoothed idf, 1 + ln(count), classes weighing alike, penalty of half the
    squared weights against the summed loss. Vocabulary and weights are whole and tables; the driver holds a few numbers for each row and
    label, whatever the texts' length. No rows or one label are an error."""
    train = cut(numbered(train.select("id", "text", F.col("label").cast("string").alias("label")), ["id"]))
    rows = train.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row for each label
    labels, n = [r["label"] for r in rows], sum(r["n"] for r in rows)
    if len(labels) < 2:
        raise ValueError("training needs rows of two labels or more")
    number = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(labels) for x in (k, i))), F.col("label"))
    known = train.select("i", number.alias("y")).toPandas()
    y = np.zeros(n, int)
    y[known["i"]] = known["y"]
    weight = (n / (len(labels) * np.bincount(y)))[y]
    # a small table may lie in one file; then a term's texts in one row
    dealt = train.select(F.col("i").alias("id"), "text").repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    terms = features(dealt).groupBy("block", "term").agg(F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("tf")).alias("tf"))
    least = F.when(F.col("block") == "word", LEAST_TEXTS["word"]).otherwise(LEAST_TEXTS["char"])
    idf = F.log((1.0 + n) / (1 + F.size("r"))) + 1
    cells = cut(terms.filter(F.size("r") >= least).withColumn("idf", idf))
    # every step reads all cells, so they are packed for it
    numbers = cut(cells.select("block", "idf", "r", "tf").mapInArrow(_chunking(n), "idf binary, size binary, r binary, tf binary"))
    context = train.sparkSession.sparkContext

    def squares(out: np.ndarray, batch: pa.RecordBatch) -> None:
        for idf, size, r, x in chunk_cells(batch):
            out[:, 0] += np.bincount(r, (x * np.repeat(idf, size)) ** 2, 2 * n)

    norms = np.sqrt(_summed(numbers, (2 * n, 1), squares))  # of texts' words, then of their characters
    scale = np.divide(1, norms, out=np.zeros_like(norms), where=norms > 0)

    def product(values: np.ndarray) -> np.ndarray:
        sent = context.broadcast(np.ascontiguousarray((scale * np.concatenate([values, values])).T))

        def add(out: np.ndarray, batch: pa.RecordBatch) -> None:
            for idf, size, r, x in chunk_cells(batch):
                starts = np.cumsum(size) - size
                for j, v in enumerate(sent.value):
                    u = idf * idf * np.add.reduceat(x * v.take(r), starts)
                    out[:, j] += np.bincount(r, x * np.repeat(u, size), 2 * n)

        try:
            both = scale * _summed(numbers, (2 * n, values.shape[1]), add)
        finally:
            sent.destroy()
        return both[:n] + both[n:]

    a, b = _minimise(product, y, weight, len(labels), rounds)
    last = context.broadcast(scale * np.concatenate([a, a]))

    def weights(batches):
        for batch in _packed(batches):
            starts, _, r, x = _cells(batch, n)
            idf = batch.column("idf").to_numpy()
            w = np.stack([idf * np.add.reduceat(x * v[r], starts) for v in last.value.T], 1)
            ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "term", "idf")), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["block", "term", "idf", "w"])

    discard(numbers)
    found = cut(cells.mapInArrow(weights, "block string, term string, idf double, w array<double>"))
    return Model(found, found.count(), labels, [float(x) for x in b])


def predict(model: Model, texts: DataFrame) -> DataFrame:
    """id, predicted (a label), confidence (its probability) of texts (id, text), ids distinct. Either block of a text has length 1; texts
    without a known feature have the intercepts alone."""
    k = len(model.intercepts)
    known = features(texts).join(model.weights, ["block", "term"]).select("block", "idf", "w", F.explode(F.arrays_zip("r", "tf")).alias("c"))
    x = (1 + F.log("c.tf")) * F.col("idf")
    each = known.groupBy(F.col("c.r").alias("id"), "block").agg(F.sqrt(F.sum(x * x)).alias("norm"), *(F.sum(x * F.get("w", F.lit(j))).alias(f"m{j}") for j in range(k)))
    sums = each.groupBy("id").agg(*(F.sum(F.col(f"m{j}") / F.col("norm")).alias(f"m{j}") for j in range(k)))
    margins = [F.coalesce(f"m{j}", F.lit(0.0)) + b for j, b in enumerate(model.intercepts)]
    margins = F.array(*([F.lit(0.0)] if len(model.labels) == 2 else []), *margins)
    rows = texts.select("id").join(sums, "id", "left").select("id", margins.alias("m")).withColumn("top", F.array_max("m"))
    label = F.get(F.array(*(F.lit(v) for v in model.labels)), (F.array_position("m", F.col("top")) - 1).cast("int"))
    others = F.aggregate("m", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top")))
    return rows.select("id", label.alias("predicted"), (1 / others).alias("confidence"))


def tfidf_lr(train: DataFrame, other: DataFrame) -> DataFrame:
    """id, predicted, confidence of each other text. Both: id, text; train: label too."""
    return predict(fit(train), other)


def routed(train: DataFrame, other: DataFrame, bearing: list[str]) -> DataFrame:
    """id, pred_state, pred_intent, confidence (of the intent) of texts (id, text) by two models: one of states (state) and one of intents
    (intent, null where a row has none). States outside of ``bearing`` carry no intent."""
    state = predict(fit(train.filter("state is not null").select("id", "text", F.col("state").alias("label"))), other)
    intent = predict(fit(train.filter("intent is not null").select("id", "text", F.col("intent").alias("label"))), other)
    both = state.select("id", F.col("predicted").alias("pred_state")).join(intent, "id")
    return both.select("id", "pred_state", F.when(F.col("pred_state").isin(bearing), F.col("predicted")).alias("pred_intent"), "confidence")

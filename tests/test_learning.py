"""The learned baselines against the same model in NumPy."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from threadlens.operators import learning

TRAIN = [
    (1, "My order was charged twice", "billing"), (2, "refund the order, charged again", "billing"), (3, "why was I charged for this?", "billing"),
    (4, "The console won't turn on", "device"), (5, "controller and console are broken", "device"), (6, "my Controller is dead", "device"),
    (7, "thanks, all good", "closing"), (8, "Thank you! good now", "closing"), (9, "ok thanks", "closing"), (10, "all good, cheers é", "closing"),
    (11, None, "device"), (12, "", "billing"),
]
OTHER = [(20, "charged for an order"), (21, "console   dead"), (22, "good, thank you"), (23, None), (24, "zzz qqq"), (25, "ok")]


def terms(text):
    text = (text or "").lower()
    words = re.findall(r"\w{2,}", text)
    found = {"word": Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)]), "char": Counter()}
    for word in text.split():
        word = f" {word} "
        for n in (3, 4, 5):
            found["char"].update(word[i : i + n] for i in range(max(1, len(word) - n + 1)))
            if len(word) <= n:
                break
    return found


def matrix(texts, vocabulary, idf):
    out = np.zeros((len(texts), len(vocabulary)))
    for row, text in zip(out, texts, strict=True):
        for block, counts in terms(text).items():
            cells = {vocabulary[block, t]: (1 + math.log(c)) * idf[block, t] for t, c in counts.items() if (block, t) in vocabulary}
            norm = math.sqrt(sum(w * w for w in cells.values()))
            for i, w in cells.items():
                row[i] = w / norm
    return out


def expected(train, other):
    seen = Counter((b, t) for _, x, _ in train for b, c in terms(x).items() for t in c)
    known = [k for k, n in seen.items() if n >= (1 if k[0] == "word" else 2)]
    vocabulary, idf = {k: i for i, k in enumerate(known)}, {k: math.log((1 + len(train)) / (1 + seen[k])) + 1 for k in known}
    labels = sorted({r[2] for r in train})
    x, y = matrix([r[1] for r in train], vocabulary, idf), np.array([labels.index(r[2]) for r in train])
    n = np.bincount(y)
    weight = len(y) / (len(labels) * n[y])
    w, b, one = np.zeros((x.shape[1], len(labels))), np.zeros(len(labels)), np.eye(len(labels))[y]

    def chance(m):
        z = m @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(20_000):
        error = weight[:, None] * (chance(x) - one)
        w, b = w - 0.05 * (x.T @ error + w), b - 0.05 * error.sum(0)
    found = chance(matrix([r[1] for r in other], vocabulary, idf))
    return {r[0]: (labels[p.argmax()], p.max()) for r, p in zip(other, found, strict=True)}, len(vocabulary)


def test_predictions_equal_numpy(spark):
    model = learning.fit(spark.createDataFrame(TRAIN, "id long, text string, label string"))
    got = {r.id: r for r in learning.predict(model, spark.createDataFrame(OTHER, "id long, text string")).collect()}
    want, size = expected(TRAIN, OTHER)
    assert model.size == size and set(got) == set(want)
    assert sorted(r.i for r in model.vocabulary.collect()) == list(range(size))
    for key, (label, confidence) in want.items():
        assert got[key].confidence == pytest.approx(confidence, abs=2e-4), key
        if key not in (23, 24):  # without a known feature classes are nearly alike
            assert got[key].predicted == label, key


def test_two_models_route(spark):
    rows = [(i, t, "new" if y != "closing" else "closing", None if y == "closing" else y) for i, t, y in TRAIN]
    train = spark.createDataFrame(rows, "id long, text string, state string, intent string")
    got = {r.id: r for r in learning.routed(train, spark.createDataFrame(OTHER, "id long, text string"), ["new"]).collect()}
    assert got[20].pred_intent == "billing" and got[21].pred_intent == "device"
    assert got[22].pred_state == "closing" and got[22].pred_intent is None and 0 < got[22].confidence <= 1


def test_one_label_is_an_error(spark):
    for rows in ([], [(1, "a b", "x")]):
        with pytest.raises(ValueError):
            learning.fit(spark.createDataFrame(rows, "id long, text string, label string"))


def test_weights_stay_off_the_driver(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i * 40 + j}" for j in range(40)) + (" good" if i % 3 else " bad"), str(i % 3 > 0)) for i in range(60)]
    seen = []
    summed = learning._summed
    monkeypatch.setattr(learning, "_summed", lambda cells, shape, add: seen.append(shape) or summed(cells, shape, add))
    model = learning.fit(spark.createDataFrame(rows, "id long, text string, label string"))
    assert model.size > 5000 and seen and max(n for n, _ in seen) == 2 * len(rows)  # two numbers for each text, none for each feature
    got = {r.id: r.predicted for r in learning.predict(model, spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string")).collect()}
    assert got == {1: "True", 2: "False"}
    assert model.weights.selectExpr("max(size(w))").first()[0] == 1


def test_two_labels_weigh_as_one_column(spark):
    rows = [(i, t, "a" if y == "billing" else "b") for i, t, y in TRAIN]
    model = learning.fit(spark.createDataFrame(rows, "id long, text string, label string"))
    w = {(r.block, r.term): (r.idf, r.w[0]) for r in model.weights.collect()}
    vocabulary, idf = {k: i for i, k in enumerate(w)}, {k: v[0] for k, v in w.items()}
    x, at = matrix([r[1] for r in rows], vocabulary, idf), np.array([v[1] for v in w.values()])
    y = np.array([r[2] == "b" for r in rows])
    each = len(y) / (2 * np.bincount(y))[y.astype(int)]
    error = each * (1 / (1 + np.exp(-(x @ at + model.intercepts[0]))) - y)
    assert np.abs(x.T @ error + at).max() < 1e-3 and abs(error.sum()) < 1e-3 and at.any()


def test_steps_read_packed_cells(spark, monkeypatch):
    """Each step of the training reads all cells, so these are a few rows of bytes then, not lists by term."""
    seen, summed = [], learning._summed
    monkeypatch.setattr(learning, "_summed", lambda cells, shape, add: seen.append((cells.count(), {t for _, t in cells.dtypes})) or summed(cells, shape, add))
    model = learning.fit(spark.createDataFrame(TRAIN, "id long, text string, label string"))
    assert len(seen) > 2 and all(kinds == {"binary"} for _, kinds in seen)
    assert max(n for n, _ in seen) < model.size / 5

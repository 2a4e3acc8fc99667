"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import dataclasses
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadlens.llm import brown, chat_windows, fair_mix, importance, line_dedup, merkle, pii, simhash, warc, winnowing
from threadlens.llm.shared import shared_path

SCHEMA = "doc_id long, text string, source string, row_id string, fp string, base string, tie string, size_ string"
LONG = "alpha beta gamma delta. " * 20_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def odd(spark):
    body = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from the old stone wall"
    return docs(spark, [(1, None, None), (2, "", "a"), (3, LONG, "a"), (4, body, "a"), (4, body, "a"), (5, body, None), (None, "x y", "b"), (6, " \n\t ", "b")])


def empty(spark):
    return docs(spark, [])


def brown_scores(rows, known, model, s):
    """Scalar class bigrams: text -> log10 probability, from the classes of words alone. rows: held out, text."""
    number = {w: i for i, w in enumerate(known.words)}
    kind = lambda w: int(model.kind_of[number[w]]) if w in number else s.classes + brown.suffix_class(w, s.suffixes)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts, bigrams, after = Counter(), Counter(), Counter()
    for held, text in rows:
        if not held:
            words = tokens(text)
            counts.update(words)
            for a, b in zip([b"\n", *words[:-1]], words, strict=True):
                bigrams[kind(a), kind(b)] += 1
                after[kind(a)] += 1
    n, v, kinds = sum(counts.values()), len(counts), s.classes + s.suffixes
    mass, types = Counter(), Counter({k: 1 for k in range(s.classes, kinds)})
    for w, c in counts.items():
        mass[kind(w)] += c
        types[kind(w)] += 1
    if b"\n" not in counts:
        types[kind(b"\n")] += 1
    whole = sum(mass[k] + 1 for k in range(kinds))

    def p(before, w):
        a, b = kind(before), kind(w)
        pair = (bigrams[a, b] + s.back_off * (mass[b] + 1) / whole) / (after[a] + s.back_off)
        return (counts[w] + 1) * (s.mix * pair / max(1, mass[b] + types[b]) + (1 - s.mix) / (n + v + 1))

    return lambda text: sum(math.log10(p(a, b)) for a, b in zip([b"\n", *tokens(text)[:-1]], tokens(text), strict=True)), counts, p


@pytest.mark.parametrize("learnt", [True, False])
def test_brown_equals_a_scalar_class_bigram(spark, learnt):
    rng = np.random.default_rng(4)
    more = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)], 30)), "s") for i in range(20, 60)]
    d = odd(spark).unionByName(docs(spark, more)).withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)) if learnt else F.lit(True))
    d = d.select("doc_id", "held_out", "text", "source")
    s = brown.Settings(clustered=8, classes=4, suffixes=4, head=25)
    known = brown.vocabulary(d.filter(~F.col("held_out")), s)
    coded = brown.encode(d, known, s)
    model = brown.train(coded.filter(~F.col("held_out")), known, s)
    rows = d.collect()
    texts = Counter((r.doc_id, r.text) for r in rows)
    value, count, p = brown_scores([(r.held_out, r.text) for r in rows], known, model, s)
    n, v = sum(count.values()), len(count)
    got = brown.score(coded, model).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n} and (not learnt or len(set(model.kind_of[9:].tolist()) & set(range(4))) > 0)
    scored = {}
    for r in got:
        text = next(t for i, t in texts if i == r.doc_id)
        words = [*(text or "").encode().lower().split(), b"\n"]
        assert r.n_tokens == len(words) and r.n_known == sum(count[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, scored.setdefault(text, value(text)), rel_tol=1e-9) and math.isfinite(r.perplexity)
    if learnt:  # over all known words and the unknown word of each suffix class, a distribution
        unknown = [next(w for i in range(9999) if brown.suffix_class(w := f"u{i:03d}".encode(), 4) == k) for k in range(4)]
        assert 0.9 < sum(p(b"w1", w) for w in [*count, *unknown]) < 1.05


def test_brown_takes_empty_tables(spark):
    none = empty(spark).select("doc_id", "text")
    known = brown.vocabulary(none)
    coded = brown.encode(none, known)
    assert brown.score(coded, brown.train(coded, known)).count() == 0


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    matrix = rng.poisson(2, (30, 30)).astype(float)

    def likelihood(of):
        one = np.eye(of.max() + 1)[of]
        p = one.T @ matrix @ one
        return brown._xlogx(p).sum() - brown._xlogx(p.sum(0)).sum() - brown._xlogx(p.sum(1)).sum()

    before = np.concatenate([np.arange(24) % 4, 4 + np.arange(6)])
    assert likelihood(brown.exchange(matrix, 24, 4, 3)) >= likelihood(before)


def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_winnowing_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pick = lambda n: " ".join(rng.choice(["aa", "bb", "Cc", "dd", "é", "x-y"], n))
    items = [(1, pick(40)), (2, pick(13)), (3, "one Two"), (4, None), (5, ""), (3, "zz"), (6, "one, two")]
    texts = [pick(60) + " " + items[i % 2][1][i : i + 70] + " " + pick(9) + " one TWO zz" for i in range(20)] + [None, "", "zz", "one", LONG]
    d = docs(spark, [(i % 22, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in winnowing.decontaminate(d, bench).collect()}
    assert got == {(i % 22, *(w := brute_hits(t, items))[:2], tuple(w[2])) for i, t in enumerate(texts)}
    assert winnowing.decontaminate(empty(spark), bench).count() == 0
    assert winnowing.decontaminate(d, bench.limit(0)).filter("n_hit > 0").count() == 0


def brute_mix(rows, budget=1.5, passes=2):
    """(doc_id, size) -> taken: all entries in one list, sorted by virtual finish and cut at the budget."""
    sized = [(i, len((t or "").split()), s) for i, t, s in rows]
    names = sorted({s for *_, s in sized}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    entries, taken = [], {k: 0 for k in range(len(rows))}
    for s in names:
        queue = sorted((hashlib.md5(":".join(["42", *([] if i is None else [str(i)]), str(n)]).encode()).hexdigest(), i, n, k) for k, (i, n, src) in enumerate(sized) if src == s)
        total, size = 0, sum(n for _, _, n, _ in queue)
        for _, _, n, k in queue:
            total += n
            entries += [((total + p * size) / weight[s], names.index(s), p, k, n) for p in range(passes) if n]
    left = int(budget * sum(n for _, n, _ in sized))
    for *_, k, n in sorted(entries):
        taken[k] += min(n, left)
        left -= min(n, left)
    return Counter((i, n, taken[k]) for k, (i, n, _) in enumerate(sized))


def test_fair_mix_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fair_mix, "SLICE_ROWS", 7)
    monkeypatch.setattr(fair_mix, "STRETCH", 3)
    rows = [(i, "w " * (i * i % 7), f"s{i % 5}" if i % 3 else "s0") for i in range(3000)] + [(9999, None, None), (9999, "a b c", None)]
    d = docs(spark, rows).withColumn("size", F.lit(999)).withColumn("taken", F.lit(1)).withColumn("after", F.lit("x"))
    for budget in (1.5, 0.3, 1.99, 2.5):
        got = fair_mix.fair_mix(d, budget=budget).collect()
        assert Counter((r.doc_id, r["size"], r.taken) for r in got) == brute_mix(rows, budget)


def test_fair_mix_reaches_targets(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 5}" if i % 3 else "s0") for i in range(3000)] + [(9999, None, None), (9999, "a b c", None)]
    got = fair_mix.fair_mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert np.allclose(by.target, by.taken, atol=7) and (by.target <= 2 * by["size"] + 1e-6).all()
    assert math.isclose(by.target.sum(), min(1.5 * got["size"].sum(), 2 * got["size"].sum()), rel_tol=1e-9)
    again = fair_mix.fair_mix(docs(spark, rows[::-1])).toPandas()
    assert again.groupby("doc_id").taken.sum().equals(got.groupby("doc_id").taken.sum())
    assert fair_mix.fair_mix(empty(spark)).count() == 0
    assert fair_mix.fair_mix(docs(spark, [(1, None, "a"), (2, "", None)])).agg(F.sum("taken")).first()[0] == 0


def test_warc_round_trip(spark):
    big = "é" * 40_000
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", big), (6, "u", big), (7, "u", "y")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, keep string")
    folder = shared_path(spark, "test")
    got = warc.read_archives(warc.write_archives(pages, folder, chunk=1000), folder, chunk=777).filter("last").collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", 0), i)
    assert len(got) == len(rows)
    for r in got:
        payload = (next(h for i, _, h in rows if i == int(r.record)) or "").encode()
        keep = best[payload.decode()]
        assert r.payload_bytes == len(payload) and r.digest_so_far == warc.base32(hashlib.sha1(payload).digest())
        assert (r.record_type, r.refers_to) == (("response", None) if keep == int(r.record) else ("revisit", str(keep)))
    named = pages.withColumn("page_id", F.concat(F.lit("p"), F.col("page_id")))
    again = warc.read_archives(warc.write_archives(named, folder + "-named"), folder).filter("last").collect()
    assert {(r.record, r.refers_to) for r in again} == {("p" + r.record, r.refers_to and "p" + r.refers_to) for r in got}
    none = warc.write_archives(pages.limit(0), folder + "-none")
    assert warc.read_archives(none, folder).count() == 0


def brute_pii(text):
    """kind, start, end of the base kinds, by the contract's patterns as they are written there."""
    digits = lambda t: [int(c) for c in t if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(len(p.lstrip("0")) < 4 and int("0" + p.lstrip("0")) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def base_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.base_spans("text").alias("b"))
    got = {r.doc_id: [(x["kind"], x["start"], x["end"]) for x in r.b] for r in rows.collect()}
    return [got[i] for i in range(len(texts))]


def test_pii_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = ["a@b.c", "_d@e.f", "@", ".", "+", "-", " ", "1", "22", "300", "1.2.3.4", "256.1.1.1", "007.1.1.1", "4111 1111-1111 1111", "+1 (415) 555-0100", "é", "😀", "x", "\n", "0", "(", ")", "%"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(3000)]
    texts += ["", "a@b.c_d@e.f", "a@b@c.d", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "1  2345678901234", "a@b.co 😀 " * 700]
    assert base_of(spark, texts) == [brute_pii(t) for t in texts]


def test_pii_takes_very_long_runs(spark):
    n = 1_000_000
    texts = ["1" * n, "a@b" + ".c" * n, "+1" + " (0" * n, "q" * n + " @", "q" * n + "@a.b", "1." * n, "1-" * n, "[" * n, "password=" + "a😀" * n, "x[at]y" + ".c" * n]
    ips = [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)]
    assert base_of(spark, texts) == [[], [("email", 0, 3 + 2 * n)], [], [], [("email", 0, n + 4)], ips, [], [], [], []]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").filter("doc_id != 5")
    assert pii.with_spans(d, pii.Model([], dict.fromkeys(pii.MORE, -1.0))).select(F.sum(F.size("personal_data.added"))).first()[0] >= 2


def test_pii_finds_and_redacts(spark):
    text = "é mail a.b@c.org, ip 10.0.0.255 not 1.2.3.999, card 4111 1111 1111 1111, call +1 (415) 555-0100. token = \"3cc5bae26c8b023b54407fd70949d250e41389c4\" on 2021-04-13"
    many = "é x.y@z.org 😀 " * 900  # more than a block
    d = docs(spark, [(1, text, "s"), (2, None, "s"), (3, "", None), (4, LONG, "s"), (1, text, "s"), (5, many, "s")])
    d = d.withColumn("added", F.lit(7)).withColumn("found", F.lit("y"))
    model = pii.fit(spark)
    rows = pii.with_spans(d, model)
    rows = rows.withColumn("clean", pii.redacted("coalesce(text, '')", "concat(personal_data.base, personal_data.added)")).collect()
    by = {r.doc_id: r for r in rows}
    assert [x["kind"] for x in by[1].personal_data.base] == ["email", "ip", "card", "phone"] and all(r.added == 7 and r.base == "x" for r in rows)
    assert all(text[x["start"] : x["end"]] == x["found"] for r in rows if r.doc_id == 1 for x in [*r.personal_data.base, *r.personal_data.added])
    assert [x["kind"] for x in by[1].personal_data.added] == ["secret"]
    clean = by[1].clean
    assert "[EMAIL]" in clean and "555" not in clean and "2021-04-13" in clean and "1.2.3.999" in clean
    assert by[2].clean == "" and by[4].clean == LONG and by[5].clean == "é [EMAIL] 😀 " * 900
    assert pii.with_spans(empty(spark), model).count() == 0
    with pytest.raises(ValueError):
        pii.with_spans(d, model, "source")


@pytest.mark.parametrize(("radius", "rows"), [(2, 4096), (2, 4), (3, 8)])
def test_simhash_links_equal_brute_force(spark, radius, rows):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(12))]))
    table = spark.createDataFrame([(bytearray(int(x).to_bytes(8, "big")),) for x in fps], "fp binary")
    s = simhash.Settings(radius=radius, shard_rows=rows)
    roots = {bytes(r.node): bytes(r.root) for r in simhash.components(simhash.links(table, s), "fp", "other").collect()}
    parent = np.arange(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    parent = simhash._join(parent, a, b)
    for x in range(len(fps)):
        own, want = (int(fps[i]).to_bytes(8, "big") for i in (x, parent[x]))
        assert roots.get(own, own) == want


def test_simhash_fingerprint_and_odd_rows(spark):
    words = ["a", "B", "c", "é", "d"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).lower().encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert int(simhash.fingerprint(" ".join(words).encode())[0]) == want
    got = simhash.near_duplicates(odd(spark)).toPandas()
    assert len(got) == 8 and set(got[got.doc_id.isin([1, 2, 6])].component) == {1} and set(got[got.doc_id.isin([4, 5])].component) == {4}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [1_000_000, 400])
def test_five_words_link_isolated_pairs_by_exact_jaccard(spark, chunk):
    rng = np.random.default_rng(9)
    texts = []
    for i in range(240):  # the end of one text is other words in the second: n - 4 shingles of which k differ
        n, j = int(rng.integers(60, 200)), (0.7, 0.75, 0.78, 0.79, 0.8, 0.81, 0.82, 0.85)[i % 8]
        k = round((n - 4) * (1 - j) / (1 + j))
        words = [f"p{i}w{x}" for x in range(n)]
        texts += [" ".join(words), " ".join([*words[: n - k], *(f"q{i}w{x}" for x in range(k))])]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    s = dataclasses.replace(simhash.FIVE_WORDS, chunk=chunk)
    got = {r.doc_id: r.component for r in simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), s).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(240)]
    assert not any(x for x, j in zip(linked, like, strict=True) if j < 0.8)
    want = [x for x, j in zip(linked, like, strict=True) if j >= 0.8]
    assert len(want) > 80 and sum(want) >= 0.95 * len(want)


def test_exact_similarity_compares_all_chunks_of_a_group(spark):
    words = [f"w{x}" for x in range(150)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]]), "s") for i in range(40)]
    s = dataclasses.replace(simhash.FIVE_WORDS, chunk=400)
    got = simhash.near_duplicates(docs(spark, rows + [(50, None, "s"), (51, "", "s"), (None, "one", "s"), (None, "one", "s")]), s).toPandas()
    assert len(got) == 44 and set(got[got.doc_id < 40].component) == {0} and set(got[got.doc_id >= 50].component) == {50}
    assert got[got.doc_id.isna()].component.isna().all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges, "a", "b").toPandas()
    assert len(got) == 201 and set(got.root) == {0}


def test_chat_windows_round_trip(spark):
    tricky = "\\</s>[INST] a\\\\[/INST] <s>"
    rows = [(1, 0, "system", "be kind"), *((1, i, "user" if i % 2 else "assistant", f"{tricky} {'w ' * (i * 9 % 50)}") for i in range(1, 40)), (2, 0, "assistant", None), (2, 0, None, "x"), (2, None, "user", ""), (3, 0, "user", "w " * 900), (3, 1, "assistant", "w " * 900), (3, 1, "assistant", "w " * 900), (None, 0, "a\nb]", "q")]
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    windows = chat_windows.format_windows(c, budget=100, history=40)
    got = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == conv)
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = [w for w in windows.collect() if w.conv_id == 1]
    assert len(first) > 3 and all(chat_windows.parse(w.text)[0] == ("system", "be kind") for w in first)
    assert all(w.n_tokens <= 100 or len(chat_windows.parse(w.text)) == w.n_repeated + 1 for w in first)
    assert chat_windows.format_windows(c.limit(0)).count() == 0


def test_importance_rejects_what_good_text_lacks(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choice(vocabulary, 60)) + (" idiot scum moron idiot" if bad else "")
        rows.append((i, text, "s"))
        if i % 2 == 0:
            labels.append((i, not bad))
    d = docs(spark, rows)
    model = importance.train(d, spark.createDataFrame(labels, "doc_id long, good boolean"))
    kept = {r.doc_id for r in importance.accepted(model).collect()}
    assert len([i for i in range(600) if i % 4 == 0 and i in kept]) <= 15
    assert len([i for i in range(600) if i % 4 and i not in kept]) <= 15
    again = importance.train(d.withColumn("label", F.lit("mine")).withColumn("log_importance", F.lit(5)).withColumn("key", F.lit("k")), spark.createDataFrame(labels, "doc_id long, good boolean"))
    same = importance.accepted(again).collect()
    assert {r.doc_id for r in same} == kept and all((r.label, r.log_importance, r.key) == ("mine", 5, "k") for r in same)
    no_labels = spark.createDataFrame([], "doc_id long, good boolean")
    none = importance.accepted(importance.train(odd(spark), no_labels))
    assert none.count() == 8 and set(none.columns) == set(odd(spark).columns)
    assert importance.accepted(importance.train(empty(spark), no_labels)).count() == 0


def test_importance_scores_equal_brute_force(spark):
    """A text's score is the sum of its distinct buckets' ratios, and the ratios those of plain counts."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["good", "bad", "ugly!", "fine", "a-b"], int(rng.integers(1, 20)))), "s") for i in range(200)]
    labels = [(i, i % 3 > 0) for i in range(0, 200, 2)]
    s = importance.Settings(bits=10)
    model = importance.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, good boolean"), s)
    sets = {i: importance._grams([t.encode()], 10)[0] for i, t, _ in rows}
    raw, seen, target = (np.zeros(2 << 10, np.int64) for _ in range(3))
    for i, grams in sets.items():
        raw[grams] += 1
        if i in model.labels and not model.labels[i][1]:
            seen[grams] += 1
            target[grams] += model.labels[i][0]
    half = 1 << 10
    want = np.concatenate([importance.log_ratios(raw[x], seen[x], target[x], s.prior, z, s.margin) for x, z in ((slice(0, half), s.shrink), (slice(half, None), s.shrink_pairs))])
    assert np.allclose(want, model.ratios)
    got = {r.doc_id: (r.log_importance, r.key) for r in model.scores.collect()}
    assert all(math.isclose(got[i][0], want[sets[i]].sum(), abs_tol=1e-9) for i in sets)
    top = sorted((k for _, k in got.values()), reverse=True)
    k = sum(score >= model.threshold for score, _ in got.values())
    assert model.cut == (-np.inf if k >= len(top) else top[k - 1])


def test_kth_largest_is_exact(spark):
    values = [float(x) for x in np.random.default_rng(4).normal(size=9000)] + [0.5] * 6000
    df = spark.createDataFrame([(v,) for v in values], "k double")
    for k in (1, 77, 6000, 9000, 14999):
        assert importance.kth_largest(df, "k", k) == sorted(values, reverse=True)[k - 1]


def brute_lines(rows, run_words):
    """doc_id -> spans that go, from the units of all texts in one list; ties of doc_ids by the row's place."""
    seen, spans = {}, {}
    for i, text in rows:  # in order of doc_id
        parts, n, start, end, edge = line_dedup.units((text or "").encode())
        first = [k for k in range(len(parts)) if edge[k] & 1]
        go = [p in seen or parts.index(p) < k for k, p in enumerate(parts)]
        keep, k = set(), 0
        while k < len(parts):
            j = k
            while j < len(parts) and go[j]:
                j += 1
            if sum(n[k:j]) >= run_words:
                keep.update(range(k, j))
            k = max(j, k + 1)
        lines = []
        for a, b in zip(first, [*first[1:], len(parts)], strict=False):
            line = "\n" + " ".join(p.decode() for p in parts[a:b])
            if sum(n[a:b]) < 5 and (line in seen or line in lines):
                keep.update(range(a, b))
            if sum(n[a:b]) < 5:
                lines.append(line)
            elif all(go[a:b]):
                keep.update(range(a, b))
        for x in [*parts, *lines]:
            seen[x] = i
        out = []
        for k in sorted(keep):
            if out and k - 1 in keep:
                out[-1][1] = int(end[k])
            else:
                out.append([int(start[k]), int(end[k])])
        spans[i] = out
    return spans


@pytest.mark.parametrize("run_words", [20, 0])
@pytest.mark.parametrize("hot", [10_000, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, run_words, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(13)
    words = [f"W{k}é" for k in range(30)]
    pick = lambda n: " ".join(rng.choice(words, n))
    passages = [pick(40) for _ in range(4)] + ["same " * 60, pick(3), pick(1)]
    rows = [(i, "\n".join(pick(int(rng.integers(0, 6))) + " " + passages[int(rng.integers(0, 7))] + " " + pick(int(rng.integers(0, 4))) for _ in range(4)), "s") for i in range(60)]
    rows += [(60, None, "s"), (61, "", "s"), (62, " \n ", "s"), (63, rows[0][1], "s")]
    got = {r.doc_id: [[x["start"], x["end"]] for x in r.spans] for r in line_dedup.dedup_lines(docs(spark, rows), run_words).collect()}
    assert got == brute_lines([(i, t) for i, t, _ in rows], run_words)


def test_line_dedup_keeps_the_first(spark):
    rng = np.random.default_rng(5)
    pick = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = pick(80)
    rows = [(i, f"{pick(30)} é {shared} {pick(30)}\nThe same Line each time\n{pick(5)}", "s") for i in range(6)] + [(7, None, "s"), (8, "", "s"), (9, LONG, "s")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert not got[0].spans and got[7].n_units == 0 and got[8].n_units == 0
    for i in range(1, 6):
        gone = " ".join(rows[i][1][s["start"] : s["end"]] for s in got[i].spans)
        assert "The same Line each time" in gone and len(set(gone.split()) & set(shared.split())) >= 60
        assert got[i].n_gone <= 85
    kept = line_dedup.dedup_lines(d).join(d.select("doc_id", "text"), "doc_id").withColumn("t", line_dedup.without(F.col("text"), F.col("spans")))
    assert "The same Line" not in next(r.t for r in kept.collect() if r.doc_id == 3)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_removes_short_lines_that_repeat_as_lines(spark):
    own = [" ".join(f"d{i}w{x}" for x in range(12)) for i in range(30)]
    rows = [(i, f"Home\n{own[i]} sign off\nTerms  of é use\n{own[i][::-1]}\nhome", "s") for i in range(29)]
    rows.append((29, f"sign off\n{own[29]}\nterms of é use", "s"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    gone = {i: [rows[i][1][s["start"] : s["end"]] for s in got[i].spans] for i in got}
    assert gone[0] == ["home"] and got[0].n_gone == 1
    assert all(gone[i] == ["Home", "Terms  of é use", "home"] and got[i].n_gone == 6 for i in range(1, 29))
    assert gone[29] == ["terms of é use"] and got[29].n_gone == 4
    assert all(got[i].n_words == len(rows[i][1].split()) for i in got)


def cut_leaves(text):
    cut, at = [], 0
    while at < len(text):
        end = next((i + 1 for i in range(at, min(at + 64, len(text))) if text[i] == "\n" and i - at <= 62 or text[i] == " " and i > at and text[i - 1] in ".!?,;:|e"), min(at + 64, len(text)))
        cut.append(text[at:end])
        at = end
    return cut or [""]


def brute_print(text):
    """A fingerprint by a scalar reading of the docstring."""
    number = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)

    def folded(items):
        seed = 42
        for x in items:
            seed = number(x, seed)
        return seed

    sections, now = [], []
    for p in re.findall(r"[^\n]*\n|[^\n]+", text) or [""]:
        hashes = [number(x) for x in cut_leaves(p)]
        h = folded(x.to_bytes(8, "little") for x in hashes)
        now.append((f"{h:016X}", "".join(f"{x % 16**5:05x}" for x in hashes)))
        if h % 8 == 0:
            sections, now = [*sections, now], []
    sections += [now] if now else []
    nodes = [folded(h for h, _ in s) for s in sections]
    root = hashlib.sha256("".join(f"{n:016X}" for n in nodes).encode()).hexdigest()[:32]
    return root + ":" + ";".join(f"{n % 16**8:08x}=" + ",".join(x for _, x in s) for n, s in zip(nodes, sections, strict=True))


def test_merkle_prints_equal_a_scalar_version(spark):
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("aebc.,: \né😀|"), int(rng.integers(0, 300)))) for _ in range(300)] + ["", "x" * 64, "x" * 63 + "\n", "a" * 1000, "e " * 500, "\n\n\n", "a\rb\n" * 60]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select("text", merkle.fingerprint(F.col("text")).alias("f"), merkle.paragraphs(F.col("text")).alias("p"))
    d = d.withColumn("whole", F.concat_ws("", F.flatten(F.transform("p", merkle.leaves))))
    for r in d.collect():
        assert r.whole == r.text and r.f == brute_print(r.text)


def test_merkle_prints_are_short_and_edits_are_near(spark):
    rows = merkle.op10_merkle(spark, "/root/testdata/sf0.001").collect()
    assert sum(len(r.fingerprint) for r in rows) <= 0.3 * sum(r.n_chars for r in rows)
    long = [r.near_edited for r in rows if r.n_chars >= 1000]
    assert np.mean(long) >= 0.6 and min(long) > 0.2 and np.mean([r.near_next for r in rows]) < 0.05


@pytest.mark.parametrize("kind", ["long", "string"])
def test_merkle_finds_the_next_and_edits(spark, monkeypatch, kind):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = [(i * i, f"Doc {i}. " + " ".join(f"Sentence {i} {j}, more." for j in range(i % 9)), "s") for i in range(1200)] + [(4, "dup", "s"), (None, "null id", "s"), (7, None, "s"), (8, "", "s"), (2**60, "far", "s"), (-(2**63), "least", "s"), (9, "same", "s"), (9, "same", "s")]
    d = docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("next_text", F.lit("x")).withColumn("k", F.lit("x"))
    got = merkle.with_next(d).withColumn("e", merkle.edited(F.col("text"), F.col("next_text"))).collect()
    cast = lambda i: i if i is None or kind == "long" else str(i)
    order = sorted(((cast(i), t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or cast(0)), reverse=True)
    following = {}
    for (a, t), (b, _) in zip(order, order[1:] + order[:1], strict=True):
        following.setdefault(a, set()).add(b)
    texts = {}
    for i, t in order:
        texts.setdefault(i, set()).add(t)
    assert len(got) == len(rows)
    for r in got:
        assert any(r.next_text in texts[b] for b in following[r.doc_id])
        k = len(r.text) // 3
        assert r.e == r.text[: len(r.text) - k] + r.next_text[:k]
    assert Counter(r.next_text for r in got) == Counter(t for _, t in order)
    assert merkle.with_next(empty(spark)).count() == 0


def test_merkle_locates_edits(spark):
    a = " ".join(f"The sentence number {i} is here." + ("\n" if i % 3 == 0 else "") for i in range(200))
    b = a.replace("number 77 ", "number 7777 ").replace("number 150 ", "")
    short = "x" * 256
    f = spark.createDataFrame([(a, b), (a, a), (short, short[:-1]), ("", "a")], "a string, b string")
    f = f.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"), F.col("a").alias("t"))
    rows = f.select("t", merkle.likeness(F.col("a"), F.col("b")).alias("like"), merkle.differing("a", "b").alias("d"), "a").collect()
    paragraphs = [s.split("=")[1].split(",") for s in rows[0].a.split(":")[1].split(";")]
    first = np.cumsum([0, *map(len, paragraphs)])
    texts = rows[0].t.splitlines(keepends=True)
    odd = [cut_leaves(texts[first[x.section] + x.paragraph])[k] for x in rows[0].d for k in x.leaves]
    assert any("77" in x for x in odd) and any("150" in x for x in odd) and len(odd) < 12
    assert 0.9 < rows[0].like < 1 and rows[1].like == 1 and not rows[1].d
    assert rows[2].like > 0.5 and rows[3].like == 0

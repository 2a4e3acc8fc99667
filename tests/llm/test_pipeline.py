from pyspark.sql import functions as F

import corpus_pipeline as cp
from threadlens.llm.shared import table, written


def test_stages_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() <= before
        before = docs.count()
        if name != "mix":
            assert docs.columns == columns
    size = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    assert docs.count() > 0 and docs.filter((F.col("taken") > 2 * size) | (F.col("taken") <= 0)).count() == 0


def test_stages_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() == 0


CLASHING = "key string, taken string, virtual_finish string, label string, log_importance string, base string, added string, personal_data string, size string, rows string, component string"
BODY = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch it from the old stone wall by the river"


def odd(spark):
    rows = [
        (1, None, "a"), (2, "", None), (3, BODY, "a"), (3, BODY, "a"), (4, BODY + " again", "b"), (None, "mail me at a.b@c.org now", "b"),
        (5, "word " * 60_000 + "1" * 200_000, "a"), (6, " \n ", "b"), (7, "some other text of its own, with é and 😀", None),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = [c.split()[0] for c in CLASHING.split(", ")]
    return d.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names)), names


def test_stages_on_odd_rows_with_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs, names = odd(spark)
    kept = {}
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, sf), name)
        rows = out.collect()
        for r in rows:  # the table's own columns come through as they are
            assert all(r[n] == f"{n}-{'null' if r.doc_id is None else r.doc_id}" for n in names)
        if name != "mix":
            assert out.columns == docs.columns
        else:
            assert out.columns == [*docs.columns, "taken_", "virtual_finish_"]
        kept[name] = rows
        docs = out
    assert len(kept["quality"]) == 9
    # texts without five words are near-duplicates only of their equals; the equal rows are one
    assert sorted(r.doc_id or 0 for r in kept["near_duplicates"]) == [0, 1, 3, 5, 7]
    assert len(kept["decontamination"]) == 5
    texts = {r.doc_id: r.text for r in kept["personal_data"]}
    assert texts[None] == "mail me at [EMAIL] now" and texts[1] is None and texts[3] == BODY
    assert all(r["taken_"] > 0 for r in kept["mix"]) and 1 not in {r.doc_id for r in kept["mix"]}


def test_stages_do_the_same_without_and_with_other_columns(spark):
    sf = "/root/testdata/sf0.001"
    plain = more = table(spark, sf, "documents")
    for column in ("key", "taken", "label", "log_importance", "base", "added", "size"):
        more = more.withColumn(column, F.lit("own"))
    for name, stage in cp.STAGES:
        plain, more = written(stage(spark, plain, sf), name), written(stage(spark, more, sf), name)
        seen = [c for c in table(spark, sf, "documents").columns]
        assert sorted(map(tuple, plain.select(seen).collect())) == sorted(map(tuple, more.select(seen).collect()))

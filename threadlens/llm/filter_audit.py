"""How filters interact: for every order of the filters, what each step removes, finds removed already, or would alone remove.

Each document becomes a mask, a bit for each filter that it fails, and documents are counted by part and mask before anything
else: at most 2^filters cells a part, whatever the table's size. Cells are then unpivoted against the steps of all orders,
a row for each cell, order and step. A running bit-or over the steps before tells what a cell failed earlier: it is gone if
that isn't zero. Sums under conditions give a step's figures, and a window over a part's rows of one filter gives its total
over all orders, its Shapley sum.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import let, table

WORD = r"[^\x20\x09-\x0D]+"
#: The filters that need the text alone, in the order of their bits; E, a copy of an earlier document's text, follows.
LETTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3, of filters A to D. A: under 200 words; B: under half of the words are distinct; C: over 2 % of the code points
    are capitals; D: a symbol of #$%&*|. Null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    sizes = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    bit = lambda condition, i: F.when(condition, 1 << i).otherwise(0)
    counted = let(sizes, lambda s: bit(s["n"] < 200, 0) + bit(100 * s["distinct"] < 50 * s["n"], 1))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return (counted + bit(100 * capitals > 2 * F.length(text), 2) + bit(text.rlike(r"[#$%&*|]"), 3)).cast("int")


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents (doc_id, text, source) have each mask, and how many of them any row of
    labels (doc_id, quality, toxic) calls good and toxic.

    A document fails E, bit 4, if its text is that of any lesser doc_id, in whatever part. Texts move as digests. No row
    finds its group of copies again, so a group of any size needs no join: all documents of a group are first counted as
    failing E, then those of its least doc_id, which a minimum finds, are moved. Documents with a null doc_id have no lesser
    one, are less than none, and have no labels. Rows that repeat a doc_id count each. A null source and null texts are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long")
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    known = docs.filter("doc_id is not null").join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # copies of a row come together where the join left them
    rows = known.groupBy("doc_id", "digest", "mask", "part", "good", "toxic").agg(F.count("*").alias("n"))
    of_id = rows.groupBy("doc_id", "digest", "mask", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    first = of_id.groupBy("digest").agg(F.min(F.struct("doc_id", "mask", "good", "toxic", "parts")).alias("f"))
    first = first.select("f.*").select("mask", "good", "toxic", F.explode("parts").alias("p")).select("p.part", "mask", "p.n", "good", "toxic")
    last = 1 << LETTERS.index("E")
    counted = lambda df, mask, sign: df.groupBy("part", mask.alias("mask")).agg(
        *((sign * F.sum(v)).alias(c) for c, v in (("n", F.col("n")), ("good", F.col("n") * F.col("good")), ("toxic", F.col("n") * F.col("toxic"))))
    )
    mask = F.col("mask")
    zero = F.lit(0).cast("long")
    unnamed = docs.filter("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    moved = (
        counted(rows, mask + last, 1).unionByName(counted(first, mask + last, -1))
        .unionByName(counted(first, mask, 1)).unionByName(counted(unnamed, mask, 1))
    )
    return moved.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).filter("n > 0")


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part, each order
    of the filters and each of its steps, zeros included.

    cells: part (not null), mask (bit i: fails the filter of letters[i]), n, good, toxic; cells of n = 0 count for nothing but
    name their part. An empty table gives an empty one. A part has as many rows as it has cells times orders times steps, so
    parts are spread over tasks and none is large.
    """
    orders = F.array(*(F.lit("".join(o)) for o in permutations(letters)))
    each = cells.repartition("part").withColumn("filter_order", F.explode(orders))
    each = each.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).filter("letter <> ''")
    bits = F.create_map(*(F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)))
    each = each.withColumns({"step": F.col("at") + 1, "bit": F.element_at(bits, F.col("letter"))})
    before = W.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("failing", F.col("mask").bitwiseAND(F.col("bit")))
    each = each.withColumn("earlier", F.coalesce(F.expr("bit_or(failing)").over(before), F.lit(0)))
    fails, gone = F.col("failing") != 0, F.col("earlier") != 0
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0))
    steps = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))

"""Seeded draws for hand labelling: items in a seeded order, one of each thread, none like another, strata with quotas.

The order is that of a hash of seed and id. A serial draw takes items in that order if they conflict with none taken before;
what it takes from a set of items is the set's first maximal independent set, which is found here in rounds on all items at
once: an item that comes before all undecided items it conflicts with is taken, and those it conflicts with leave. Threads and
equal texts conflict through the least of their group, so no group is paired with itself; only unlike texts that are
near-duplicates are pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.operators import retrieval
from threadlens.operators.scores import hashed
from threadlens.sources.tables import cut

NEAR_DUPLICATE = 0.95


def independent(items: DataFrame, links: DataFrame) -> DataFrame:
    """id, place of the items that a serial draw by place would take.

    items: id, place (distinct, orderable), thread, text_id; links: a, b, the text_ids that conflict, both ways. Items of one
    thread conflict, and items of one text_id. A null thread or text_id conflicts with none. As many rounds as decisions
    depend on one another, about the logarithm of the number of items.
    """
    left, taken = cut(items.select("id", "place", "thread", "text_id")), None
    while not left.isEmpty():
        least = lambda c: left.filter(f"{c} is not null").groupBy(c).agg(F.min("place").alias(f"first_{c}"))
        by_text = least("text_id")
        near = links.join(by_text.select(F.col("text_id").alias("b"), "first_text_id"), "b").groupBy(F.col("a").alias("text_id")).agg(F.min("first_text_id").alias("first_near"))
        seen = left.join(least("thread"), "thread", "left").join(by_text, "text_id", "left").join(near, "text_id", "left")
        before = lambda c: F.col(c).isNull() | (F.col("place") <= F.col(c))
        new = cut(seen.filter(before("first_thread") & before("first_text_id") & before("first_near")).select("id", "place", "thread", "text_id"))
        taken = new if taken is None else taken.unionByName(new)
        hit = new.select("text_id").unionByName(links.join(new.select(F.col("text_id").alias("a")), "a").select(F.col("b").alias("text_id"))).distinct()
        left = left.join(new.select("id"), "id", "left_anti").join(new.select("thread").distinct(), "thread", "left_anti").join(hit, "text_id", "left_anti")
        left = cut(left.select("id", "place", "thread", "text_id"))
    return (left if taken is None else taken).select("id", "place")


def draw(
    pool: DataFrame, fills: list[tuple[str, Column, int]], seed: str = "42", near: float | None = NEAR_DUPLICATE,
    kept_out: DataFrame | None = None, strict: bool = True, window: int = 4,
) -> DataFrame:
    """id, slice, nr of the items drawn: for each fill (name, condition, n) in order the first n items of the pool that meet its
    condition, that share no thread with one drawn before, and that are no near-duplicates (a cosine of ``near`` or more)
    of one drawn before nor of a text of ``kept_out`` (text). ``near`` None: threads alone count.

    pool: id (distinct), thread, text and what conditions read. Raises if a fill falls short and ``strict``. Weights of
    n-grams are those of the whole pool and ``kept_out``; candidates are looked at ``window`` times n at a time, in order, and
    more only if these don't fill the quota, so a draw compares what it may draw and not the pool with itself.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = pool.withColumns({"place": F.struct(hashed(F.lit(seed), F.col("id")).alias("h"), F.col("id").alias("i")), "text_id": digest})
    rows = cut(rows.select("id", "place", "thread", "text_id", *(c.alias(f"in_{i}") for i, (_, c, _) in enumerate(fills))))
    vectors, out = None, None
    if near is not None:
        texts = pool.select(digest.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        out = None if kept_out is None else cut(kept_out.select(digest.alias("id")).distinct())
        if kept_out is not None:
            texts = texts.unionByName(kept_out.select(digest.alias("id"), F.coalesce("text", F.lit("")).alias("text")))
        vectors = retrieval.vectors(texts.groupBy("id").agg(F.first("text").alias("text"), F.count("*").alias("m")), ["id"])
        # texts without any n-gram that counts are like nothing, not even their copies
        rows = cut(rows.join(vectors.select(F.col("id").alias("text_id"), F.lit(True).alias("known")).distinct(), "text_id", "left"))
        rows = rows.withColumn("text_id", F.when(F.col("known"), F.col("text_id")))
    else:
        rows = rows.withColumn("text_id", F.lit(None).cast("string"))
    no_links = rows.select(F.col("text_id").alias("a"), F.col("text_id").alias("b")).limit(0)
    drawn, count = None, 0
    for i, (name, _, n) in enumerate(fills):
        able = rows.filter(F.col(f"in_{i}"))
        if drawn is not None:
            able = able.join(drawn.select("thread").distinct(), "thread", "left_anti").join(drawn.select("id"), "id", "left_anti")
        size, whole = window * n, able.count()
        while True:
            head = cut(able.orderBy("place").limit(size).select("id", "place", "thread", "text_id"))
            links = no_links
            if near is not None:
                of = lambda ids: vectors.join(ids.filter("text_id is not null").select(F.col("text_id").alias("id")).distinct(), "id", "left_semi")
                fixed = [] if drawn is None else [drawn.select("text_id")]
                fixed += [] if out is None else [out.select(F.col("id").alias("text_id"))]
                for f in fixed:
                    like = retrieval.pairs_above(of(head), of(f), near).select(F.col("a").alias("text_id")).unionByName(f.select("text_id")).distinct()
                    head = cut(head.join(like, "text_id", "left_anti"))
                vs = cut(of(head))
                links = cut(retrieval.pairs_above(vs, vs, near).select("a", "b"))
            found = cut(independent(head, links).orderBy("place").limit(n))
            got = found.count()
            if got == n or size >= whole:
                break
            size *= max(2, window)
        if got < n and strict:
            raise ValueError(f"only {got} of {n} candidates for {name}")
        nr = F.row_number().over(W.orderBy("place")) + count  # at most n rows
        new = cut(head.join(found.select("id"), "id").withColumns({"slice": F.lit(name), "nr": nr}))
        drawn, count = new if drawn is None else drawn.unionByName(new), count + got
    return drawn.select("id", "slice", "nr")

"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents queue in a pseudo-random order that depends on the seed and the document alone, and the queue may
run ``passes`` times. A document's virtual finish, in each pass, is the words its source has queued up to and with it,
divided by the source's weight. All entries, sorted by virtual finish over all sources, are taken until their words reach
the budget; the entry in service at that moment is taken as far as the budget goes. A source that has run all its passes
queues nothing more, so that the others share what it leaves by their weights.

Prefix sums are taken in levels: inside slices of a queue, over the slices of a stretch, over stretches. The place where the
budget ends is found by summing words in ever narrower ranges of virtual finish. So a source with a third of all
documents is spread over as many tasks as it has slices, and no task or driver sees more than a bounded part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import table, with_row_id, written

BUDGET, PASSES, SEED = 1.5, 2, 42
WEIGHTS = (3.0, 1.0, 2.0)
SLICE_ROWS = 500
STRETCH = 1000


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def repeating_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, weight: sources in code point order, null last, take the weights in turn."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*(F.lit(float(w)) for w in weights))
    return sources.select("source").distinct().select("source", F.get(listed, F.pmod(place, F.lit(len(weights)))).alias("weight"))


def fair_targets(sources: DataFrame, budget: Column, passes: float = PASSES) -> DataFrame:
    """source, weight, source_size -> the same with end (the virtual time at which the budget is used up) and target.

    Until the time t a source gives min(weight * t, passes * source_size). With sources ordered by when they run out, the
    sum is linear between those times, so the end is found in the first stretch that reaches the budget. Sources without
    weight give nothing; if all run out first, the end is when the last does.
    """
    cap = F.col("source_size") * F.lit(float(passes))
    out = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(0.0))
    w = W.orderBy("out", "weight", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    running = F.sum("weight").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = sources.withColumn("cap", F.when(F.col("weight") > 0, cap).otherwise(F.lit(0.0))).withColumn("out", out)
    rows = rows.withColumn("all", F.sum("source_size").over(W.partitionBy(F.lit(1))))
    reach = F.when(F.col("running") > 0, (budget - F.col("capped")) / F.col("running"))
    rows = rows.withColumn("capped", capped).withColumn("running", running).withColumn("reach", reach)
    once = W.partitionBy(F.lit(1))
    first = F.min(F.when(F.col("reach") <= F.col("out"), F.struct("out", "reach"))).over(once)
    rows = rows.withColumn("first", first).withColumn("last", F.max("out").over(once))
    return rows.withColumn("end", F.coalesce("first.reach", "last")).select(
        "source", "weight", "source_size", "end", F.least("cap", F.col("weight") * F.col("end")).alias("target")
    )


def _queue(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """row_id, doc_id, source, size, source_size, weight, target, o, after: words queued up to and with the document."""
    # the sources' table has a row for each source; Spark broadcasts it only below its size threshold
    rows = sized.alias("d").join(sources.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("d.doc_id").cast("string"), F.col("d.size")).cast("binary"))
    share = F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    rows = rows.select(
        "d.row_id", "d.doc_id", "d.source", "d.size", "t.source_size", "t.weight", "t.target", order.alias("o"),
        F.floor(share * F.col("t.slices")).alias("slice"),
    )
    rows = written(rows, "queue")
    stretch = F.floor(F.col("slice") / F.lit(STRETCH))
    sums = written(rows.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("stretch", stretch), "slices")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wide = sums.groupBy("source", "stretch").agg(F.sum("n").alias("n"))
    wide = wide.select("source", "stretch", earlier(W.partitionBy("source").orderBy("stretch")).alias("base"))
    inside = earlier(W.partitionBy("source", "stretch").orderBy("slice"))
    before = sums.select("source", "slice", "stretch", inside.alias("inside")).alias("b")
    before = before.join(wide.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")) & (F.col("b.stretch") == F.col("w.stretch")))
    before = before.select("b.source", "b.slice", (F.col("inside") + F.col("base")).alias("before")).alias("p")
    own = W.partitionBy("source", "slice").orderBy("o", "doc_id", "size", "row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("own", F.sum("size").over(own)).alias("r")
    rows = rows.join(before, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice")))
    return rows.select("r.*", (F.col("p.before") + F.col("r.own")).alias("after")).drop("own", "slice")


def _budget_end(entries: DataFrame, budget: int, bins: int = 1024, few: int = 4096) -> tuple[float, int]:
    """The virtual finish at which the words of entries (finish, size), in its order, reach the budget, and the words of
    all entries before it. Words are summed in ever narrower ranges of finish; the driver gets at most ``bins`` sums at a time."""
    low, high, n = entries.agg(F.min("finish"), F.max("finish"), F.count("*")).first()
    if not n:
        return float("inf"), 0
    part, before = entries, 0
    while n > few and low < high:
        width = (high - low) / bins
        place = F.least(F.lit(bins - 1), F.floor((F.col("finish") - F.lit(low)) / F.lit(width))).cast("int")
        found = part.groupBy(place.alias("b")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi"))
        for r in sorted(found.collect()):
            if before + r.w >= budget:
                low, high, n = r.lo, r.hi, r.n
                break
            before += r.w
        else:
            return float("inf"), before
        part = part.filter(F.col("finish").between(F.lit(low), F.lit(high)))
    # few entries, or entries of one virtual finish, one for each source at most
    for r in part.groupBy("finish").agg(F.sum("size").alias("w")).orderBy("finish").toLocalIterator():
        if before + r.w >= budget:
            return r.finish, before
        before += r.w
    return float("inf"), before


def fair_mix(
    documents: DataFrame,
    weights: DataFrame | None = None,
    budget: float = BUDGET,
    passes: int = PASSES,
    seed: int = SEED,
    size: Column | None = None,
) -> DataFrame:
    """How many words of each document (doc_id, source, text) the mix takes.

    weights: source, weight (default: ``repeating_weights``). budget: as a share of all words. size: words of a document,
    where they are known already. Returns row_id, doc_id, source, size, source_size, weight, target, virtual_finish, taken.
    virtual_finish is that of the first pass.

    Documents without words take none; null is a source like any other; repeated documents are ordered by doc_id and
    then as they come, each with words of its own. Order follows seed, doc_id and size only, so reruns agree. Entries
    of several sources that finish at the moment when the budget ends are taken in order of source and pass. An empty table
    gives no rows. Other columns are ignored.
    """
    counted = (word_count(F.col("text")) if size is None else size).cast("long")
    sized = written(with_row_id(documents.select("doc_id", "source", counted.alias("size"))), "sizes")
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    weights = repeating_weights(sums) if weights is None else weights.select("source", F.col("weight").cast("double"))
    joined = sums.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
    joined = joined.select("s.*", F.coalesce("w.weight", F.lit(0.0)).alias("weight"))
    targets = fair_targets(joined, F.lit(float(budget)) * F.col("all"), passes)
    targets = targets.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(SLICE_ROWS)))
    rows = written(_queue(sized, written(targets.select("t.*", slices.alias("slices")), "targets"), seed), "virtual")

    total = int(float(budget) * (sums.agg(F.sum("source_size")).first()[0] or 0))
    finish = (F.col("after") + F.col("pass") * F.col("source_size")) / F.col("weight")
    entries = rows.filter("size > 0 and weight > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(passes)))))
    entries = entries.select("source", "row_id", "size", "pass", finish.alias("finish"))
    end, before = _budget_end(entries.select("finish", "size"), total)
    # at the end itself at most one entry of each source stands
    last = entries.filter(F.col("finish") == F.lit(end))
    served = F.sum("size").over(W.orderBy(F.col("source").asc_nulls_last(), "pass").rowsBetween(W.unboundedPreceding, -1))
    left = F.lit(total - before) - F.coalesce(served, F.lit(0))
    last = last.withColumn("left", left).groupBy("row_id").agg(F.sum(F.greatest(F.lit(0), F.least("size", "left"))).alias("part"))
    whole = F.lit(0)
    for k in range(passes):
        whole = whole + F.when((F.col("after") + k * F.col("source_size")) / F.col("weight") < F.lit(end), 1).otherwise(0)
    taken = F.when(F.col("weight") > 0, whole * F.col("size")).otherwise(0) + F.coalesce("part", F.lit(0))
    return rows.join(last, "row_id", "left").select(
        "row_id", "doc_id", "source", "size", "source_size", "weight", "target",
        F.when(F.col("weight") > 0, F.col("after") / F.col("weight")).alias("virtual_finish"), taken.cast("long").alias("taken"),
    )


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = fair_mix(table(spark, sf_dir, "documents"))
    return mix.orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id", "row_id").select(
        "doc_id", "size", "source_size", "target", "taken", "virtual_finish"
    )

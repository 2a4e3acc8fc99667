"""Exact quantiles of any number of distinct values, by counts in ever narrower ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.sources.tables import cut

#: Parts of a range that are counted in a round, and most targets that are broadcast.
PARTS, BROADCAST = 1024, 100_000


def exact(rows: DataFrame, value: str, shares: list[float], groups: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """groups, q, value: the quantiles of a numeric column for each share q, with linear interpolation between neighbours, for all
    rows or each group.

    A quantile lies between the values of one or two ranks. For each rank a round counts the values in ``parts`` equal parts of
    its range, keeps the part that holds the rank, and goes on with that part's least and greatest value, until these are
    equal; a round leaves about one of ``parts`` values, so few rounds see more than a handful. Counts are combined
    before they move and no task holds a group's values. Targets, a row for each group and rank, are broadcast if they are
    at most ``BROADCAST``, joined otherwise. Nulls and NaN don't count; a group without values has no rows.
    """
    groups = groups or []
    v = F.col(value).cast("double")
    rows = cut(rows.select(*groups, v.alias("v")).filter("v is not null and not isnan(v)"))
    whole = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n > 0")
    places = cut(whole.select(*groups, "n", "lo", "hi", F.explode(F.array(*map(F.lit, shares))).alias("q")).withColumn("at", F.col("q") * (F.col("n") - 1)))
    both = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    targets = places.select(*groups, F.explode(both).alias("rank"), "lo", "hi").distinct().withColumn("below", F.lit(0).cast("long"))
    targets, found = cut(targets), None
    while True:
        done = targets.filter("lo = hi").select(*groups, "rank", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        open_ = targets.filter("lo < hi")
        left = open_.count()
        if not left:
            break
        near = F.broadcast(open_) if left <= BROADCAST else open_
        within = rows.join(near, groups or F.lit(True)).filter("v between lo and hi")
        part: Column = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))
        counts = within.groupBy(*groups, "rank", "below", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(W.partitionBy(*groups, "rank").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        targets = cut(counts.select(*groups, "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("below")))
    found = cut(found)
    of = lambda side, name: found.select(*groups, F.col("rank").alias(side), F.col("v").alias(name))
    ends = places.withColumns({"low": F.floor("at"), "high": F.ceil("at")}).join(of("low", "v_low"), [*groups, "low"]).join(of("high", "v_high"), [*groups, "high"])
    share = F.col("at") - F.col("low")
    return ends.select(*groups, "q", F.when(share > 0, (1 - share) * F.col("v_low") + share * F.col("v_high")).otherwise(F.col("v_low")).alias("value"))

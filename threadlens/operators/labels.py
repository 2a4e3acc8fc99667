"""Label tables: strict joins, codebook rows, tallies of a coded sample, ranked candidates, and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators.scores import hashed


def joined_all(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The inner join; raises if a row of ``left`` has no partner. The check reads the keys alone."""
    missing = left.select(on).join(right.select(on), on, "left_anti").take(3)
    if missing:
        raise ValueError(f"no partner for {on}: {[r[0] for r in missing]}")
    return left.join(right, on)


def codebook_rows(spark: SparkSession, intents: dict[str, list[str]], states: dict[str, list[str]]) -> DataFrame:
    """record_id, state, intent, source: a label row for each example of a codebook. The other label stays empty."""
    rows = [(i, "", k) for k, ids in intents.items() for i in ids] + [(i, k, "") for k, ids in states.items() for i in ids]
    made = spark.createDataFrame(rows, "record_id string, state string, intent string")
    return made.withColumn("source", F.lit("codebook_examples"))


def tallies(coded: DataFrame) -> DataFrame:
    """what, a, b, n over a coded sample (state, intent, secondary, subtype, event; blanks are empty or null):
    several issues in a row, subtypes within intents (untagged included), events with their intent or else state, and
    intents with their rows tied to an event. One pass: a row gives one record for each count it takes part in."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    one = lambda what, a, b: F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"))
    none, named = F.lit(""), F.when(blank("intent"), F.col("state")).otherwise(F.col("intent"))
    each = F.array_compact(F.array(
        F.when(~blank("intent") & ~blank("secondary"), one("several", none, none)),
        F.when(~blank("intent"), one("subtype", F.col("intent"), F.coalesce("subtype", none))),
        F.when(~blank("event"), one("event", F.col("event"), named)),
        F.when(~blank("intent") & ~blank("event"), one("tied", F.col("intent"), none)),
    ))
    return coded.select(F.explode(each).alias("r")).groupBy("r.what", "r.a", "r.b").agg(F.count("*").alias("n"))


def candidates(rows: DataFrame, flags: dict[str, Column], note: str, id_: str) -> DataFrame:
    """Rows with any flag or note, flags listed; noted ones first, then those of more flags, then by id."""
    found = rows.withColumn("flags", F.array_compact(F.array(*(F.when(c, k) for k, c in flags.items()))))
    noted = F.trim(F.coalesce(F.col(note), F.lit(""))) != ""
    return found.filter((F.size("flags") > 0) | noted).orderBy(F.desc(noted), F.desc(F.size("flags")), id_)


def bucket_sample(rows: DataFrame, buckets: dict[str, Column], n: int, id_: str, seed: str = "42") -> DataFrame:
    """Up to n rows for each bucket, bucket added; a row counts for the first bucket whose condition it meets, so none is
    drawn twice. The order is that of a hash of seed and id. A bucket's ranking needs only its first n: Spark cuts each
    partition to them before it shuffles."""
    first = F.coalesce(*(F.when(c, k) for k, c in buckets.items()))
    kept = rows.withColumn("bucket", first).filter("bucket is not null").withColumn("_h", hashed(F.lit(seed), F.col(id_)))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("_h", id_))
    return kept.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r", "_h")


def thread_sample(messages: DataFrame, n: int, least: int = 2, most: int = 8, seed: str = "42") -> DataFrame:
    """The messages (thread, ...) of n threads of ``least`` to ``most`` messages."""
    sizes = messages.groupBy("thread").agg(F.count("*").alias("size")).filter(F.col("size").between(least, most))
    picked = sizes.orderBy(hashed(F.lit(seed), F.col("thread")), "thread").limit(n).select("thread")
    return messages.join(picked, "thread", "left_semi")


def behaviours(signals: Column, text: Column, n_words: Column, is_followup: Column, context: Column) -> dict[str, Column]:
    """A condition for each behaviour that a development sample is to hold. signals: the customer's weak codes; context: turns
    (role, text), oldest first."""
    last = F.get(context, F.size(context) - 1)
    asked = F.coalesce((last["role"] == "brand") & last["text"].contains("?"), F.lit(False))
    has = lambda code: F.array_contains(signals, code)
    return {
        "strong_anger": has("anger"),
        "repeat_contact": has("repeat_contact_cue") | has("prior_contact"),
        "account_specific": text.rlike("(?i)" + T.SAMPLE_ACCOUNT),
        "vague_low_confidence": (n_words <= 6) & ~is_followup,
        "after_clarification": is_followup & asked,
        "repair_replacement": text.rlike("(?i)" + T.SAMPLE_REPAIR),
    }


def development_set(labels: DataFrame, key: DataFrame, pool: DataFrame, cue_names: list[str]) -> DataFrame:
    """Labels (dev_id, record_id, escalate, cue_...) with the slice of their key (dev_id) and the text and reply of their record
    in the pool (record_id): blanks trimmed, cues as booleans, null where neither yes nor no. Raises for a label without either."""
    trimmed = labels.select(*(F.trim(c).alias(c) for c in labels.columns))
    rows = joined_all(joined_all(trimmed, key.select("dev_id", "slice"), "dev_id"), pool, "record_id")
    said = lambda c: F.when(F.lower(c) == "yes", True).when(F.lower(c) == "no", False)
    rows = rows.withColumns({f"cue_{n}": said(f"cue_{n}") for n in cue_names} | {"label_escalates": F.col("escalate") == "yes"})
    handoff = (F.col("reply_type") == "dm_deflection") | F.lower("brand_reply").rlike(T.HANDOFF)
    return rows.withColumn("handed_off", handoff)


def rated_pairs(human: DataFrame, judge: DataFrame, dimensions: list[str], on: str) -> DataFrame:
    """dimension, human, judge of each item that both rated: a row for each dimension that neither left blank."""
    named = lambda d, side: d.select(on, *(F.col(x).try_cast("int").alias(f"{x}_{side}") for x in dimensions))
    both = named(human, "human").join(named(judge, "judge"), on)
    one = F.array(*(F.struct(F.lit(x).alias("dimension"), F.col(f"{x}_human").alias("human"), F.col(f"{x}_judge").alias("judge")) for x in dimensions))
    return both.select(F.explode(one).alias("r")).select("r.*").filter("human is not null and judge is not null")


def judged_summary(calls: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row of a judge's run (error, tokens, latency_s, the dimensions): scored, failed, of these rate limits, mean and largest latency
    and tokens, and the mean of each dimension."""
    good = F.col("error").isNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    mean = lambda c, digits: F.round(F.avg(F.when(good, F.col(c))), digits)
    return calls.agg(
        n(good).alias("scored"), n(~good).alias("failed"), n(T.rate_limit(F.col("error")).isNotNull()).alias("rate_limited"),
        mean("latency_s", 2).alias("mean_latency"), F.max(F.when(good, F.col("latency_s"))).alias("max_latency"), mean("tokens", 0).alias("mean_tokens"),
        *(mean(d, 3).alias(f"mean_{d}") for d in dimensions),
    )


def require_apart(corpus: DataFrame, golden: DataFrame, key: str = "record_id") -> DataFrame:
    """corpus as it is, if none of its keys is a golden item's; otherwise an error that names up to five. Null keys are no item's."""
    met = [r[key] for r in corpus.select(key).join(golden.select(key).distinct(), key, "left_semi").distinct().orderBy(key).limit(5).collect()]
    if met:
        raise ValueError(f"training rows touch the golden set: {met}")
    return corpus

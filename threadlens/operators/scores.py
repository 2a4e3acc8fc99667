"""Metrics over label tables: classification reports, weighted and plain kappa, bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators import policy


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, p, r, f1, support of each class that is true or predicted somewhere; zero where undefined. One pass: each
    row counts for its true and its predicted class."""
    each = rows.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("class"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    is_t, is_p = (F.col("t") == F.col("class")).cast("long"), (F.col("p") == F.col("class")).cast("long")
    sums = each.groupBy("class").agg(F.sum(is_t * is_p).alias("tp"), F.sum(is_t).alias("support"), F.sum(is_p).alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        "class",
        ratio(F.col("tp"), F.col("said")).alias("p"),
        ratio(F.col("tp"), F.col("support")).alias("r"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return class_report(rows, truth, predicted).agg(F.avg("f1").alias("f1"), F.count("*").alias("n_classes"))


def kappa(rows: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """kappa of two raters, null where one of them is constant; with squared distances as weights if ``weighted``. Works on
    the table of pair counts, whose size is that of the label set squared."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    left = pairs.groupBy("a").agg(F.sum("o").alias("na"))
    right = pairs.groupBy("b").agg(F.sum("o").alias("nb"))
    total = pairs.agg(F.sum("o").alias("n"))
    cost = lambda: (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) if weighted else (F.col("a") != F.col("b")).cast("long")
    seen = pairs.agg(F.sum(cost() * F.col("o")).alias("seen"))
    # the two marginals have one row for each label
    chance = left.join(right, F.lit(True)).agg(
        F.sum(cost() * F.col("na") * F.col("nb")).alias("chance"),
        F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"),
    )
    value = 1 - F.col("seen") * F.col("n") / F.nullif("chance", F.lit(0))
    return seen.join(chance, F.lit(True)).join(total, F.lit(True)).select(
        F.when((F.col("ka") > 1) & (F.col("kb") > 1), value).alias("kappa")
    )


def hashed(*parts: Column) -> Column:
    """A number that Spark and other engines compute alike: eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


DRAWS, SEED = 10_000, 42
# Conversation states, and those that carry an intent.
STATES = ["new_issue", "issue_followup", "acknowledgement_closing", "social_offtopic"]
BEARING = ["new_issue", "issue_followup"]
LABELS = ["gold_state", "pred_state", "gold_intent", "pred_intent", "gold_escalate", "pred_escalate"]


def _draws(kinds: DataFrame, draws: int, seed: int, value, names: list[str]) -> DataFrame:
    """draw, metric, value of resamples of all rows, rows being alike if they are of one kind. kinds: n first, then whatever
    ``value`` (counts by draw and kind, columns -> array by name) reads. The kinds, as many as labels combine, go to all tasks;
    to resample n rows is to draw how many there are of each kind, so draws cost the same for any number of rows."""
    table = kinds.toPandas()
    counts = table["n"].to_numpy(float)
    spark = kinds.sparkSession
    block = 250

    def run(batches):
        for batch in batches:
            for b in batch["id"]:
                size = min(block, draws - b * block)
                rng = np.random.default_rng([seed, b])
                taken = rng.multinomial(int(counts.sum()), counts / counts.sum(), size) if counts.sum() else np.zeros((size, 0))
                found = value(taken.astype(float), table)
                for name in names:
                    yield pd.DataFrame({"draw": np.arange(size) + b * block, "metric": name, "value": found[name]})

    return spark.range(0, -(-draws // block), 1, max(1, -(-draws // block) // 4)).mapInPandas(run, "draw long, metric string, value double")


def _interval(draws: DataFrame) -> DataFrame:
    """metric, lo, hi: 2.5 and 97.5 percent of the draws; draws in which a metric is undefined don't count."""
    known = F.when(~F.isnan("value"), F.col("value"))
    cuts = draws.groupBy("metric").agg(F.percentile(known, F.array(F.lit(0.025), F.lit(0.975))).alias("c"))
    return cuts.select("metric", F.round(F.get("c", F.lit(0)), 6).alias("lo"), F.round(F.get("c", F.lit(1)), 6).alias("hi"))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def bootstrap_mean(rows: DataFrame, value: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """value, lo, hi, n: the mean of a number column over all rows but null ones, and its interval over resamples.

    Each draw takes each row a Poisson number of times, of mean 1, so rows are drawn where they are and alike ones at once (n of
    them: mean n); draws' sums add up. Seeds come from the value, so partitions don't matter. Without rows all but n are null.
    """
    kinds = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("h", F.xxhash64("v"))
    block = 1000

    def run(batches):
        taken, sums = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            for v, n, h in zip(batch["v"], batch["n"], batch["h"], strict=True):
                times = np.random.default_rng([seed, int(h) & (2**64 - 1)]).poisson(n, draws)
                taken += times
                sums += times * v
        for at in range(0, draws, block):
            yield pd.DataFrame({"draw": np.arange(at, min(draws, at + block)), "taken": taken[at : at + block], "sums": sums[at : at + block]})

    each = kinds.mapInPandas(run, "draw long, taken double, sums double").groupBy("draw").agg(F.sum("taken").alias("taken"), F.sum("sums").alias("sums"))
    found = _interval(each.select(F.lit("mean").alias("metric"), F.try_divide("sums", "taken").alias("value")))
    whole = rows.agg(F.round(F.avg(value), 6).alias("value"), F.count(value).alias("n"))
    return whole.join(found, F.lit(True), "left").select("value", "lo", "hi", "n")


def _f1(taken: np.ndarray, gold: np.ndarray, pred: np.ndarray, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean F1 over classes that are true or predicted in a draw, and their number."""
    total, classes = np.zeros(len(taken)), np.zeros(len(taken))
    for label in labels:
        both = taken @ ((gold == label) & (pred == label)).astype(float)
        there = taken @ (gold == label).astype(float) + taken @ (pred == label).astype(float)
        total += np.divide(2 * both, there, out=np.zeros(len(taken)), where=there > 0)
        classes += there > 0
    return _ratio(total, classes), classes


def _routing(taken: np.ndarray, t: pd.DataFrame) -> dict[str, np.ndarray]:
    gs, ps = t["gold_state"].to_numpy(), t["pred_state"].to_numpy()
    gi, pi = t["gold_intent"].fillna("").to_numpy(), t["pred_intent"].fillna("").to_numpy()
    ge, pe = t["gold_escalate"].to_numpy(bool), t["pred_escalate"].to_numpy(bool)
    bearing = np.isin(gs, BEARING)
    must = ge & np.isin(gi, [k for k, v in policy.RISKS.items() if v == "high"])
    share = lambda a, b: _ratio(taken @ a.astype(float), taken @ b.astype(float))
    all_ = np.ones(len(t), bool)
    state_f1, state_classes = _f1(taken, gs, ps, STATES)
    part = taken * bearing
    intent_f1, intent_classes = _f1(part, gi, pi, list(policy.RISKS))
    return {
        "state_accuracy": share(gs == ps, all_),
        "state_macro_f1": state_f1,
        "state_macro_f1_classes": state_classes,
        "intent_macro_f1": intent_f1,
        "intent_macro_f1_classes": intent_classes,
        "intent_accuracy": share(bearing & (gi == pi), bearing),
        "escalation_precision": share(ge & pe, pe),
        "escalation_recall": share(ge & pe, ge),
        "must_escalate_recall": share(must & pe, must),
        "joint_routing_correctness": share((gs == ps) & (ge == pe) & ((gi == pi) | ~bearing), all_),
    }


ROUTING = [
    "state_accuracy", "state_macro_f1", "state_macro_f1_classes", "intent_macro_f1", "intent_macro_f1_classes", "intent_accuracy",
    "escalation_precision", "escalation_recall", "must_escalate_recall", "joint_routing_correctness",
]


def routing_metrics(rows: DataFrame) -> DataFrame:
    """metric, value, support over all rows (LABELS; intents may be null). Intents count where the true state carries
    one, a missing prediction as an error; must_escalate: escalated rows whose true intent alone is of high risk."""
    g, p = F.col, F.col
    eq = lambda a, b: F.coalesce(g(a), F.lit("")) == F.coalesce(p(b), F.lit(""))
    bearing = g("gold_state").isin(BEARING)
    must = g("gold_escalate") & g("gold_intent").isin([k for k, v in policy.RISKS.items() if v == "high"])
    states, escalations = eq("gold_state", "pred_state"), g("gold_escalate") == p("pred_escalate")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = g("gold_escalate") & p("pred_escalate")
    parts = {
        "state_accuracy": (n(states), F.count("*")),
        "intent_accuracy": (n(bearing & eq("gold_intent", "pred_intent")), n(bearing)),
        "escalation_precision": (n(both), n(p("pred_escalate"))),
        "escalation_recall": (n(both), n(g("gold_escalate"))),
        "must_escalate_recall": (n(must & p("pred_escalate")), n(must)),
        "joint_routing_correctness": (n(states & escalations & (eq("gold_intent", "pred_intent") | ~bearing)), F.count("*")),
    }
    one = rows.agg(*(F.struct(F.try_divide(a, b).alias("value"), b.cast("long").alias("support")).alias(k) for k, (a, b) in parts.items()))
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).value.alias("value"), F.col(k).support.alias("support")) for k in parts))
    found = one.select(F.explode(each).alias("x")).select("x.*")
    for name, part, labels in (("state", rows, STATES), ("intent", rows.filter(bearing), list(policy.RISKS))):
        report = class_report(part, f"gold_{name}", f"pred_{name}").filter(F.col("class").isin(labels))
        found = found.unionByName(report.agg(F.lit(f"{name}_macro_f1").alias("metric"), F.avg("f1").alias("value"), F.coalesce(F.sum("support"), F.lit(0)).alias("support")))
    return found


def routing_intervals(rows: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """metric, value, lo, hi, fewer: each metric with its interval over resamples of all rows; fewer: the share, in
    percent, of draws in which a mean F1 has fewer classes than over all rows."""
    kinds = rows.groupBy(*LABELS).agg(F.count("*").alias("n")).orderBy(*LABELS)
    table = kinds.toPandas()  # a row for each combination of labels
    whole = _routing(table["n"].to_numpy(float)[None, :], table)
    drawn = _draws(kinds, draws, seed, _routing, ROUTING)
    drawn = drawn.withColumn("full", F.element_at(F.create_map(*(F.lit(x) for k in ROUTING for x in (k, float(whole[k][0])))), F.col("metric")))
    fewer = drawn.filter(F.col("metric").endswith("_classes")).groupBy(F.replace("metric", F.lit("_classes"), F.lit("")).alias("metric"))
    fewer = fewer.agg(F.round(100 * F.avg(F.when(F.col("value") < F.col("full"), 1).otherwise(0)), 1).alias("fewer"))
    value = F.round(F.nanvl(F.element_at(F.create_map(*(F.lit(x) for k in ROUTING for x in (k, float(whole[k][0])))), F.col("metric")), F.lit(None).cast("double")), 6)
    found = _interval(drawn).filter(~F.col("metric").endswith("_classes")).withColumn("value", value)
    return found.join(fewer, "metric", "left").select("metric", "value", "lo", "hi", "fewer")


def kappa_interval(rows: DataFrame, a: str, b: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """value, lo, hi: quadratic weighted kappa and its interval; draws in which a rater is constant don't count."""
    kinds = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).orderBy("a", "b")

    def value(taken: np.ndarray, t: pd.DataFrame) -> dict[str, np.ndarray]:
        x, y = t["a"].to_numpy(float), t["b"].to_numpy(float)
        xs, ys = np.unique(x), np.unique(y)
        left = np.stack([taken[:, x == v].sum(1) for v in xs], 1)
        right = np.stack([taken[:, y == v].sum(1) for v in ys], 1)
        chance = np.einsum("di,ij,dj->d", left, (xs[:, None] - ys[None, :]) ** 2, right)
        found = 1 - _ratio((taken @ (x - y) ** 2) * taken.sum(1), chance)
        return {"kappa": np.where(((left > 0).sum(1) > 1) & ((right > 0).sum(1) > 1), found, np.nan)}

    found = _interval(_draws(kinds, draws, seed, value, ["kappa"]))
    return kappa(rows, a, b, weighted=True).select(F.round("kappa", 6).alias("value")).join(found, F.lit(True)).select("value", "lo", "hi")


def flag_scores(rows: DataFrame, name: str, truth: str, predicted: str) -> DataFrame:
    """name, tp, fp, fn, p, r of boolean flags, and of all together as ``micro``; p and r are null where undefined."""
    each = rows.select(F.explode(F.array(F.col(name), F.lit("micro"))).alias(name), F.col(truth).alias("t"), F.col(predicted).alias("s"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = each.groupBy(name).agg(n(F.col("t") & F.col("s")).alias("tp"), n(~F.col("t") & F.col("s")).alias("fp"), n(F.col("t") & ~F.col("s")).alias("fn"))
    ratio = lambda other: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), 6)
    return sums.select(name, "tp", "fp", "fn", ratio("fp").alias("p"), ratio("fn").alias("r"))


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """truth, predicted, n for each pair of labels, 0 where there is none; other labels don't count."""
    spark = rows.sparkSession
    one = spark.createDataFrame([(x, y) for x in labels for y in labels], "truth string, predicted string")
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return one.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def failures(rows: DataFrame) -> DataFrame:
    """pattern, n: which fields of a row are wrong together, as state+intent+escalate; wrong escalations are over or under."""
    bearing = F.col("gold_state").isin(BEARING)
    intent = F.coalesce("gold_intent", F.lit("")) != F.coalesce("pred_intent", F.lit(""))
    wrong = F.array_compact(F.array(
        F.when(F.col("gold_state") != F.col("pred_state"), "state"),
        F.when(bearing & intent, "intent"),
        F.when(F.col("pred_escalate") & ~F.col("gold_escalate"), "over").when(F.col("gold_escalate") & ~F.col("pred_escalate"), "under"),
    ))
    return rows.select(F.array_join(wrong, "+").alias("pattern")).filter("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("n"))


def baselines(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows with the predictions of the baselines that know no text: the most frequent true state and intent (of equals the
    first by name), with escalation never, always, or as the policy decides on the intent alone."""
    most = lambda c: F.get(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(c).alias("v")))), 0)["v"]
    top = lambda c: rows.filter(f"{c} is not null").groupBy(c).agg(F.count("*").alias("n")).agg(most(c).alias("v"))
    state, intent = top("gold_state").withColumnRenamed("v", "pred_state"), top("gold_intent").withColumnRenamed("v", "pred_intent")
    said = rows.drop("pred_state", "pred_intent", "pred_escalate").join(state, F.lit(True), "left").join(intent, F.lit(True), "left")
    always = F.coalesce(F.col("pred_intent").isin("purchases_billing_orders", "support_process_complaint"), F.lit(False))
    return {
        "majority": said.withColumn("pred_escalate", always),
        "always_escalate": said.withColumn("pred_escalate", F.lit(True)),
        "never_escalate": said.withColumn("pred_escalate", F.lit(False)),
    }

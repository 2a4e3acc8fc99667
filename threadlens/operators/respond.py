"""The agent's flow over tables of model responses: repair of a proposal, cues from both sides, drafts, final rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.policy import draft_checks

#: States that carry no intent, the intent of cases without one, the reason and trigger of failed drafts.
NO_INTENT = ["acknowledgement_closing", "social_offtopic"]
VAGUE, FAILED_REASON, FAILED_TRIGGER = "needs_more_context", "REPLY_FAILED_CHECKS", "validation"


def repaired_intent(state: Column, intent: Column) -> Column:
    """The intent that a state allows: none for closings and small talk, the vague one where none was given."""
    return F.when(~state.isin(NO_INTENT), F.coalesce(F.nullif(intent, F.lit("")), F.lit(VAGUE)))


def repairs(state: Column, intent: Column) -> Column:
    """What ``repaired_intent`` did: dropped, filled or null."""
    none = F.coalesce(intent, F.lit("")) == ""
    return F.when(state.isin(NO_INTENT) & ~none, "dropped").when(~state.isin(NO_INTENT) & none, "filled")


def cue_union(model: dict[str, Column], rules: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Each cue that either side reports, and the names of those that only the rules found. Null counts as not reported."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    both = {k: yes(model[k]) | yes(rules[k]) for k in model}
    added = F.array_compact(F.array(*(F.when(yes(rules[k]) & ~yes(model[k]), k) for k in model)))
    return both, added


def respond(routed: DataFrame, drafts: DataFrame, attempts: int = 2, most: int = 280) -> DataFrame:
    """Rows of ``routed`` with reply, draft_attempts, errors, and escalate, reason, trigger, reason_text as they end.

    Escalated cases stay as they are, with no reply and no attempts. Of the others the first draft without errors is the
    reply; if all fail, the case is escalated with the last draft's errors, its risk carried over. A draft that the response
    table lacks counts as empty.

    routed: request_id, escalate, reason, trigger, risk, reason_text, said, evidence; drafts: request_id, attempt, draft
    (one row for a pair). One join: the drafts of a request are checked together.
    """
    tries = range(1, attempts + 1)
    asked = drafts.groupBy("request_id").agg(*(F.max(F.when(F.col("attempt") == i, F.col("draft"))).alias(f"draft_{i}") for i in tries))
    rows = routed.join(asked, "request_id", "left")
    errors = lambda i: draft_checks(F.col(f"draft_{i}"), F.col("said"), F.coalesce("evidence", F.lit("")), most)
    checked = [F.struct(F.lit(i).alias("attempt"), F.coalesce(f"draft_{i}", F.lit("")).alias("draft"), errors(i).alias("errors")) for i in tries]
    rows = rows.withColumn("tried", F.when(~F.col("escalate"), F.array(*checked)))
    good = F.filter("tried", lambda x: F.size(x["errors"]) == 0)
    rows = rows.withColumn("best", F.when(F.size(good) > 0, F.element_at(good, 1))).withColumn("last", F.element_at("tried", attempts))
    failed = ~F.col("escalate") & F.col("best").isNull()
    said_why = F.concat(F.lit("the drafted reply failed its checks: "), F.array_join("last.errors", "; "))
    return rows.withColumn("failed", failed).select(
        *(c for c in routed.columns if c not in ("escalate", "reason", "trigger", "reason_text")),
        (F.col("escalate") | F.col("failed")).alias("escalate"),
        F.when(F.col("failed"), FAILED_REASON).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("failed"), FAILED_TRIGGER).otherwise(F.col("trigger")).alias("trigger"),
        F.when(F.col("failed"), said_why).otherwise(F.col("reason_text")).alias("reason_text"),
        F.coalesce("best.draft", F.lit("")).alias("reply"),
        F.when(F.col("escalate"), 0).otherwise(F.coalesce("best.attempt", F.lit(attempts))).alias("draft_attempts"),
        F.when(F.col("failed"), F.col("last.errors")).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def finalized(rows: DataFrame, system: str) -> DataFrame:
    """The scored output of finished rows; a row without state or decision stops the job when it is computed."""
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"unfinished row: no {c}"))).otherwise(F.col(c))
    return rows.select(
        "request_id", F.lit(system).alias("system"), need("state").alias("state"), "intent", "confidence",
        F.coalesce("reply", F.lit("")).alias("reply"), need("escalate").alias("escalate"), need("reason").alias("reason"), "reason_text",
    )

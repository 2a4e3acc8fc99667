"""The cue extractor on plain sentences, and metrics against item-by-item resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import cues, policy, scores

SAID = [
    ("I already tried that", {"steps_failed"}),
    ("i tried and it did not fail", set()),
    ("I have not done anything", {"steps_failed"}),
    ("no luck after a factory reset", {"steps_failed"}),
    ("I contacted your support team", {"repeat_contact"}),
    ("this is the third time, for 3 weeks", {"repeat_contact"}),
    ("absolute joke, moving to PlayStation", {"strong_anger"}),
    ("I was charged twice", {"money_dispute"}),
    ("how do I refund a game", {"account_specific_action"}),
    ("someone has signed in, I was hacked", {"account_compromised"}),
    ("my lawyer will call", {"harm_or_legal"}),
    ("it needs repair under warranty", {"repair_or_replacement"}),
    ("where is my order", {"account_specific_action"}),
    ("hello there", set()),
    (None, set()),
]


def test_cues_of_a_message(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "i long, said string")
    none = F.lit(None).cast("array<struct<role:string,text:string>>")
    got = {r.i: {e["cue"] for e in r.e} for r in rows.select("i", cues.evidence(F.col("said"), none).alias("e")).collect()}
    for i, (said, want) in enumerate(SAID):
        assert got[i] == want, said


def test_cues_of_the_turns_before(spark):
    context = [("customer", "I was charged twice"), ("brand", "Could you tell us more?"), ("other_brand", "I was hacked"), ("customer", "charged again")]
    rows = spark.createDataFrame([("ok " + "x" * 80, context)], "said string, context array<struct<role:string,text:string>>")
    shown = cues.evidence(F.col("said"), F.col("context"))
    got = [tuple(e) for e in rows.select(shown.alias("e")).first().e]
    assert got == [("money_dispute", "charged twice", "customer_context"), ("prior_clarification", "Could you tell us more?", "brand_context")]
    assert rows.select(cues.flags(shown)["money_dispute"]).first()[0]
    old = cues.legacy_flags(F.col("said"), F.col("context"))
    assert not rows.select(old["prior_clarification"] | old["money_dispute"]).first()[0]  # the last turn is the customer's


def test_low_confidence_escalates_as_the_model(spark):
    none = {c: F.lit(False) for c in policy.CUES}
    d = spark.range(1).select(policy.decide(F.lit("product_info_feedback"), none, F.lit(True)).alias("d")).first().d
    assert (d.escalate, d.reason, d.trigger, d.risk) == (True, "LOW_CONFIDENCE", "model", "low")


def test_intents_resolution_and_formats(spark):
    cases = ["is this backwards compatible", "game won't start", "someone reported me", "plain words"]
    first, hits = T.first_of(F.col("t"), T.INTENTS, "needs_more_context")
    got = [tuple(r) for r in spark.createDataFrame([(c,) for c in cases], "t string").select(first, hits).collect()]
    assert got == [("product_info_feedback", 1), ("hardware_devices", 2), ("enforcement_safety", 1), ("needs_more_context", 0)]
    texts = [None, "that worked", "thanks a lot", "nothing works", "hm"]
    ways = ["no_customer_answer", "fix_confirmed", "thanks_only", "unresolved_cue", "other_answer"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.resolution(F.col("t"))).collect()] == ways
    assert spark.sql("select timestamp'2017-10-01 12:00:59' t").select(T.iso_minutes(F.col("t"))).first()[0] == "2017-10-01T12:00Z"
    kinds = [("please restart", False), ("please restart", True), ("dm us", False)]
    assert [r[0] for r in spark.createDataFrame(kinds, "t string, c boolean").select(T.first_reply_type(F.col("t"), F.col("c"))).collect()] == ["substantive", "other_reply", "dm_deflection"]


FIXTURE = [
    ("new_issue", "new_issue", "hardware_devices", "hardware_devices", False, False),
    ("new_issue", "new_issue", "purchases_billing_orders", "purchases_billing_orders", True, True),
    ("social_offtopic", "new_issue", None, "software_game_app", False, False),
    ("issue_followup", "issue_followup", "hardware_devices", "software_game_app", True, False),
]
SCHEMA = "gold_state string, pred_state string, gold_intent string, pred_intent string, gold_escalate boolean, pred_escalate boolean"


def test_routing_metrics_of_a_small_table(spark):
    got = {r.metric: (r.value, r.support) for r in scores.routing_metrics(spark.createDataFrame(FIXTURE, SCHEMA)).collect()}
    assert got["state_accuracy"] == (0.75, 4) and got["intent_accuracy"][0] == pytest.approx(2 / 3)
    assert got["escalation_precision"] == (1, 1) and got["escalation_recall"] == (0.5, 2)
    assert got["joint_routing_correctness"] == (0.5, 4) and got["must_escalate_recall"] == (1, 1)


def test_intervals_agree_with_resampling_items(spark):
    rows = FIXTURE * 25
    got = {r.metric: r for r in scores.routing_intervals(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = np.array([r[0] == r[1] for r in rows], float)
    draws = right[np.random.default_rng(0).integers(0, len(rows), (10_000, len(rows)))].mean(1)
    low, high = np.percentile(draws, [2.5, 97.5])
    assert abs(got["state_accuracy"].lo - low) < 0.011 and abs(got["state_accuracy"].hi - high) < 0.011
    assert got["state_macro_f1"].fewer == 0.0 and got["state_accuracy"].value == 0.75
    few = {r.metric: r for r in scores.routing_intervals(spark.createDataFrame(FIXTURE, SCHEMA), 2000).collect()}
    assert few["state_macro_f1"].fewer > 20 and few["must_escalate_recall"].lo == 1
    again = {r.metric: r for r in scores.routing_intervals(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert again == got


def test_kappa_interval_and_flag_scores(spark):
    same = spark.createDataFrame([(i % 5 + 1, i % 5 + 1) for i in range(50)], "a long, b long")
    assert tuple(scores.kappa_interval(same, "a", "b", 500).first()) == (1.0, 1.0, 1.0)
    constant = spark.createDataFrame([(3, i % 5 + 1) for i in range(50)], "a long, b long")
    assert tuple(scores.kappa_interval(constant, "a", "b", 500).first()) == (None, None, None)
    flags = spark.createDataFrame([("x", True, True), ("x", False, True), ("y", True, False)], "cue string, t boolean, s boolean")
    got = {r.cue: (r.tp, r.fp, r.fn) for r in scores.flag_scores(flags, "cue", "t", "s").collect()}
    assert got == {"x": (1, 1, 0), "y": (0, 0, 1), "micro": (1, 1, 1)}
    empty = spark.createDataFrame([], SCHEMA)
    assert all(r.value is None for r in scores.routing_intervals(empty, 250).collect())

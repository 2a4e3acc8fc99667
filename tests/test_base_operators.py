"""Operators on small hand-made threads, texts and labels."""

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import policy, scores, threads
from threadlens.sources import tables


def thread(spark, rows):
    return spark.createDataFrame(rows, "tweet_id long, author string, inbound boolean, created long, parent long, text string")


def test_reply_parts_are_merged_in_order(spark):
    m = thread(spark, [(1, "c", True, 0, None, "q"), (2, "b", False, 10, 1, "x"), (3, "b", False, 12, 2, "y"), (4, "b", False, 60, 3, "late")])
    got = threads.merged_replies(m, threads.anchored(m)).collect()
    assert [(r.anchor, r.n_parts, r.merged) for r in got] == [(1, 2, "x y")]


def test_customer_parts_are_merged_upwards(spark):
    m = thread(spark, [(1, "c", True, 0, None, "a"), (2, "c", True, 1, 1, "b"), (3, "b", False, 5, 2, "r")])
    assert [tuple(r) for r in threads.merged_messages(m).collect()] == [(2, 1, 2)]


def test_answered_message_is_not_merged(spark):
    m = thread(spark, [(1, "c", True, 0, None, "a"), (9, "b", False, 0, 1, "r"), (2, "c", True, 1, 1, "b"), (3, "b", False, 5, 2, "r")])
    assert {tuple(r) for r in threads.merged_messages(m).collect()} == {(1, 1, 1), (2, 2, 1)}


def test_roots_and_orphans_of_a_deep_thread(spark):
    rows = [(i, "c", True, i, i - 1 if i > 1 else None, "") for i in range(1, 130)] + [(500, "c", True, 0, 499, "")]
    got = {r.tweet_id: (r.root, r.orphan) for r in threads.thread_roots(thread(spark, rows)).collect()}
    assert all(got[i] == (1, False) for i in range(1, 130)) and got[500] == (500, True)


def test_text_cleaning(spark):
    row = spark.range(1).select(
        T.clean_customer(F.lit("@a @b Hi &amp; see https://x.y/z  @c")).alias("c"),
        T.clean_brand_part(F.lit("@a Try this 1/2 ^TJ https://x.y")).alias("b"),
        T.template_key(F.lower(F.lit("@bob Please DM us! 123 ^JK"))).alias("t"),
        T.has_guidance(F.lit("Can you DM us what you see when you try to sign in?")).alias("no"),
        T.has_guidance(F.lit("Restart the console. Then DM us.")).alias("yes"),
        T.parse_wait(F.lit("try again in 11m17.376s.")).alias("wait"),
        T.parse_wait(F.lit("try again in 1h2m3s")).alias("hours"),
        T.parse_wait(F.lit("no")).alias("none"),
        T.normalise_url(F.lit("HTTPS://www.A.com/b).")).alias("url"),
        T.part_number(F.lit("more 2/2 ^JL")).alias("part"),
    ).first()
    assert (row.c, row.b, row.t) == ("Hi & see <URL> @user", "Try this <URL>", "please dm us")
    assert (row.no, row.yes, row.wait, row.hours, row.none) == (False, True, 677.376, 3723.0, None)
    assert (row.url, row.part) == ("a.com/b", 2)


def test_wilson(spark):
    low, high = spark.range(1).select(*T.wilson(F.lit(0), F.lit(0))).first()
    assert (low, high) == (0.0, 0.0)
    low, high = spark.range(1).select(*T.wilson(F.lit(5), F.lit(10))).first()
    assert low == pytest.approx(0.2366, abs=1e-4) and high == pytest.approx(0.7634, abs=1e-4)


def decide(spark, intent, *cues):
    flags = {c: F.lit(c in cues) for c in policy.CUES}
    return spark.range(1).select(policy.decide(F.lit(intent), flags).alias("d")).first().d


def test_policy_rules(spark):
    assert decide(spark, "purchases_billing_orders").reason == "ACCOUNT_SPECIFIC"
    assert decide(spark, "support_process_complaint", "repeat_contact").reason == "REPEAT_CONTACT"
    assert decide(spark, "software_game_app", "steps_failed").reason == "STEPS_FAILED"
    only_risk = decide(spark, "software_game_app", "repeat_contact")
    assert (only_risk.escalate, only_risk.risk, only_risk.reason) == (False, "medium", "ROUTINE_TROUBLESHOOTING")
    assert not decide(spark, "software_game_app", "strong_anger").escalate
    assert decide(spark, "hardware_devices", "strong_anger").escalate
    both = decide(spark, "hardware_devices", "money_dispute", "steps_failed")
    assert (both.reason, both.text) == ("BILLING_DISPUTE", "money dispute; the steps already failed")


def checks(spark, draft, said, evidence):
    return spark.range(1).select(policy.draft_checks(F.lit(draft), F.lit(said), F.lit(evidence)).alias("c")).first().c


def test_draft_checks(spark):
    assert checks(spark, " ", "", "") == ["empty"]
    assert checks(spark, "Please restart it.", "it froze", "restart the console") == []
    assert checks(spark, "Please restart it.", "I tried a restart", "restart") == ["repeats_tried_steps"]
    assert checks(spark, "See https://a.com/x.", "", "www.a.com/x") == []
    assert checks(spark, "See https://b.com and <URL>, $5", "", "none") == ["unsupported_link", "placeholder", "unsupported_amount"]
    assert checks(spark, "Please DM us and check your messages", "", "") == ["dm_deflection"]
    assert checks(spark, "unplug it", "", "update it") == ["unsupported_steps"]


def test_scores(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    f1, n = scores.macro_f1(pairs, "t", "p").first()
    assert n == 2 and f1 == pytest.approx(2 / 3)
    same = spark.createDataFrame([(1, 1), (5, 5), (3, 3)], "a int, b int")
    assert scores.kappa(same, "a", "b", weighted=True).first()[0] == 1.0
    flat = spark.createDataFrame([(3, 4), (3, 4), (3, 2)], "a int, b int")
    assert scores.kappa(flat, "a", "b").first()[0] is None


def test_readers(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,Tue Oct 31 22:10:47 +0000 2017,"Two\nlines, ""q""",,\n2,b,False,Tue Oct 31 22:11:45 +0000 2017,,,1\n')
    one, two = tables.load_raw(spark, str(path)).orderBy("tweet_id").collect()
    assert one.text == 'Two\nlines, "q"' and str(one.created_at) == "2017-10-31 22:10:47" and two.text == "" and two.in_response_to_tweet_id == 1
    with pytest.raises(ValueError):
        tables.load_split(spark, str(tmp_path), "excluded")

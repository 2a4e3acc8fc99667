"""Exchanges on hand-made threads: several customers, split replies, announcements, missing parents."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import assembly, threads

SCHEMA = "tweet_id long, parent long, conv_id long, author string, inbound boolean, created long, text string"


def table(spark, rows):
    return spark.createDataFrame([(i, p, 1, a, a != "shop", m, t) for i, p, a, m, t in rows], SCHEMA)


def found(spark, rows):
    return {r.record_id: r for r in threads.exchanges(table(spark, rows)).collect()}


def test_next_text_is_the_same_customers_to_any_part(spark):
    got = found(spark, [
        (1, None, "ann", 0, "it broke"), (2, 1, "shop", 10, "try this 1/2"), (3, 1, "shop", 10, "and that 2/2"), (4, 2, "bob", 11, "me too"),
        (5, 3, "ann", 20, "that worked"), (6, 2, "ann", 30, "later"),
    ])
    assert set(got) == {1} and (got[1].reply_id, got[1].n_reply_parts, got[1].reply_delay) == (2, 2, 10)
    assert got[1].next_text == "that worked" and not got[1].is_followup


def test_followups_answer_a_reply_that_is_in_the_data(spark):
    chain = [(1, None, "ann", 0, "a"), (2, 1, "shop", 10, "b"), (3, 2, "ann", 30, "c"), (4, 3, "shop", 40, "d")]
    got = found(spark, chain)
    assert not got[1].is_followup and got[3].is_followup and got[1].next_text == "c"
    assert not found(spark, [(2, None, "shop", 0, "news"), (3, 2, "ann", 5, "c"), (4, 3, "shop", 9, "d")])[3].is_followup
    assert not found(spark, [(2, 77, "shop", 0, "to one unseen"), (3, 2, "ann", 5, "c"), (4, 3, "shop", 9, "d")])[3].is_followup


def test_own_earlier_messages_belong_to_the_message(spark):
    got = found(spark, [(1, None, "ann", 0, "a"), (2, 1, "ann", 1, "b"), (3, 2, "shop", 5, "c"), (4, 2, "shop", 60, "late")])
    assert set(got) == {2} and (got[2].first_id, got[2].n_customer_parts, got[2].n_reply_parts) == (1, 2, 2)


@pytest.mark.parametrize("marks", [("2/2 second", "1/2 first"), ("second 2", "first 1"), ("@ann 2: second", "@ann 1: first")])
def test_parts_of_one_minute_follow_their_markers(spark, marks):
    rows = table(spark, [(1, None, "ann", 0, "a"), (2, 1, "shop", 10, marks[0].replace("2/2 second", "second 2/2")), (3, 1, "shop", 10, marks[1].replace("1/2 first", "first 1/2"))])
    merged = threads.merged_replies(rows, threads.anchored(rows)).first().merged
    assert merged.index("first") < merged.index("second")


def test_assembled_records(spark):
    rows = []
    for k in range(30):
        day = k * 1440
        rows += [(10 * k + 1, None, f"c{k % 4}", day, f"my console number {k} is broken and hacked"), (10 * k + 2, 10 * k + 1, "shop", day + 5, "please restart it" if k % 2 else f"dm us, case {'xyz'[k % 3] * (k + 1)}")]
        rows += [(10 * k + 3, 10 * k + 2, f"c{k % 4}", day + 9, "that worked, thanks")]
    records = assembly.exchange_records(table(spark, rows))
    at = assembly.suggested_cut(records).first()[0]
    out = assembly.assemble(records, at)
    assert out.columns == assembly.COLUMNS
    got = {r.record_id: r for r in out.collect()}
    assert len(got) == 30 and {r.split for r in got.values()} == {"train", "holdout"}
    assert all(r.weak_outcome is None and r.max_train_similarity is not None for r in got.values() if r.split == "holdout")
    train = [r for r in got.values() if r.split == "train"]
    assert all(r.weak_outcome == "resolved" for r in train) and got[11].reply_is_canned and not got[1].reply_is_canned
    assert "security" in got[1].customer_escalation_signals and "prior_contact" in got[41].customer_escalation_signals and "prior_contact" not in got[1].customer_escalation_signals
    assert got[1].brand_escalation_evidence == ["dm_request"]
    assert assembly.shared_threads(out).count() == 0
    report = {r.split: r.n for r in assembly.split_report(out).collect()}
    assert sum(report.values()) == 30 and assembly.grounding_corpus(out).filter(F.col("split") != "train").count() == 0

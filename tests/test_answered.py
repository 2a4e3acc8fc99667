"""The plain exchange builder on a small thread, item by item."""

from threadlens.operators import threads

SCHEMA = "tweet_id long, parent long, conv_id long, author string, inbound boolean, created long, text string"
ROWS = [
    (1, None, 1, "u", True, 0, "@brand My Console is broken http://x.y/z"),
    (2, 1, 1, "brand", False, 5, "Please DM us"),
    (3, 2, 1, "brand", False, 6, "or restart it"),
    (4, 3, 1, "brand", False, 40, "too late to belong"),
    (5, 3, 1, "v", True, 7, "another customer"),
    (6, 3, 1, "u", True, 9, "it works now, thank you for it"),
    (7, 2, 1, "u", True, 12, "later answer"),
    (8, 6, 1, "brand", False, 13, None),
    (9, None, 2, "w", True, 20, "my console is broken!"),
    (10, 9, 2, "brand", False, 21, "Please DM us"),
    (11, None, 3, "x", True, 22, "dm sent to you"),
    (12, 11, 3, "brand", False, 23, "Please DM us"),
    (13, None, 4, "y", True, 24, "ok"),
    (14, 13, 4, "brand", False, 25, "please dm us!"),
    (15, None, 5, "z", True, 26, "no answer for the customer here"),
]


def test_answered_messages(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.record_id: r for r in threads.answered(rows, canned_from=4).collect()}
    assert set(got) == {1, 6, 9, 11, 13}
    one = got[1]
    assert (one.reply, one.n_parts, one.all_canned, one.action, one.dm) == ("Please DM us or restart it", 2, False, True, True)
    assert (one.clean, one.n_words, one.letters, one.next_id, one.is_followup) == ("my console is broken", 4, "my console is broken", 6, False)
    assert got[6].is_followup and got[6].reply == "" and not got[6].all_canned and got[6].next_id is None
    assert all(got[i].all_canned and got[i].dm for i in (9, 11, 13)) and got[9].letters == "my console is broken"
    steps = {r.step: r.kept for r in threads.waterfall(threads.answered(rows)).collect()}
    assert steps == {"answered": 5, "not_foreign": 5, "enough_words": 4, "no_hand_off": 3, "first_of_equals": 2}


def test_no_messages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert threads.answered(none).count() == 0
    assert {r.kept for r in threads.waterfall(threads.answered(none)).collect()} == {0} and threads.waterfall(threads.answered(none)).count() == 5

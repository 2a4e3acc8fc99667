"""Context folding, the response flow, prompts, stores and report sinks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from threadlens.functions import prompts
from threadlens.functions import text as T
from threadlens.operators import context, respond, threads
from threadlens.sources import stores

MESSAGE = "tweet_id long, author string, inbound boolean, created long, parent long, text string"


def folded(spark, rows, first):
    m = spark.createDataFrame(rows, MESSAGE)
    records = m.filter(F.col("tweet_id") == first).select(F.col("tweet_id").alias("record_id"), F.col("tweet_id").alias("first_id"), F.col("author").alias("customer"))
    parts = threads.anchored(m)
    got = context.context_turns(m, records, parts, threads.merged_replies(m, parts), "b")
    return [(r.role, r.created, r.text, r.truncated) for r in got.orderBy("turn_no").collect()]


def test_context_shows_a_split_reply_whole_and_once(spark):
    rows = [(1, "c", True, 0, None, "q"), (2, "b", False, 10, 1, "x"), (3, "b", False, 12, 2, "y"), (4, "c", True, 20, 3, "now")]
    assert folded(spark, rows, 4) == [("customer", 0, "q", False), ("brand", 10, "x y", False)]
    # the chain passes through the first part only; the reply is whole all the same
    assert folded(spark, [*rows[:3], (4, "c", True, 20, 2, "now")], 4) == [("customer", 0, "q", False), ("brand", 10, "x y", False)]


def test_context_joins_neighbours_of_one_author_and_names_others(spark):
    rows = [(1, "d", True, 0, None, "hey"), (2, "c", True, 1, 1, "a"), (3, "c", True, 40, 2, "b"), (4, "z", False, 41, 3, "o"), (5, "c", True, 50, 4, "now")]
    assert folded(spark, rows, 5) == [("other_customer", 0, "hey", False), ("customer", 1, "a b", False), ("other_brand", 41, "o", False)]


def test_context_keeps_opener_and_last_two_and_cuts_by_age(spark):
    who = [("c", True), ("d", True)]
    rows = [(i, *who[i % 2], i * 100, i - 1 if i > 1 else None, f"t{i}") for i in range(1, 7)]
    assert [t[2] for t in folded(spark, rows, 6)] == ["t1", "t4", "t5"] and folded(spark, rows, 6)[0][3]
    old = [(1, "d", True, 0, None, "old"), (2, "d", True, 20_000, 1, "new"), (3, "c", True, 20_010, 2, "now")]
    assert folded(spark, old, 3) == [("other_customer", 20_000, "new", True)]
    assert folded(spark, old, 1) == []


def test_context_takes_at_most_fifty_ancestors(spark):
    rows = [(i, "d", True, i, i - 1 if i > 1 else None, f"t{i}") for i in range(1, 70)] + [(70, "c", True, 70, 69, "now")]
    m = spark.createDataFrame(rows, MESSAGE)
    records = m.filter("tweet_id = 70").select(F.col("tweet_id").alias("record_id"), F.col("tweet_id").alias("first_id"))
    got = context.chains(m, records).filter("step > 0")
    assert got.count() == 50 and got.agg(F.min("tweet_id")).first()[0] == 20 and not got.first().stale


def test_response_flow(spark):
    routed = spark.createDataFrame(
        [(1, True, "LEGAL", "rule", "high", "legal", "sue", "e"), (2, False, "G", "policy", "low", "", "hi", "restart it"),
         (3, False, "G", "policy", "low", "", "hi", "restart it"), (4, False, "G", "policy", "medium", "", "hi", None)],
        "request_id long, escalate boolean, reason string, trigger string, risk string, reason_text string, said string, evidence string",
    )
    drafts = spark.createDataFrame([(1, 1, "no"), (2, 1, "Restart it."), (3, 1, "x" * 300), (3, 2, "Restart it."), (4, 1, "see http://a.b/c")], "request_id long, attempt int, draft string")
    got = {r.request_id: r for r in respond.respond(routed, drafts).collect()}
    assert (got[1].reply, got[1].draft_attempts, got[1].reason, got[1].escalate) == ("", 0, "LEGAL", True)
    assert (got[2].reply, got[2].draft_attempts, got[2].escalate) == ("Restart it.", 1, False)
    assert (got[3].reply, got[3].draft_attempts, got[3].errors) == ("Restart it.", 2, [])
    assert (got[4].reply, got[4].reason, got[4].trigger, got[4].risk) == ("", "REPLY_FAILED_CHECKS", "validation", "medium")
    assert got[4].errors == ["empty"] and got[4].reason_text.endswith("empty")


def test_repair_cues_and_final_rows(spark):
    rows = spark.createDataFrame([("new_issue", None), ("new_issue", "a"), ("social_offtopic", "a"), ("social_offtopic", None)], "state string, intent string")
    got = rows.select(respond.repaired_intent(F.col("state"), F.col("intent")), respond.repairs(F.col("state"), F.col("intent"))).collect()
    assert [tuple(r) for r in got] == [("needs_more_context", "filled"), ("a", None), (None, "dropped"), (None, None)]
    both, added = respond.cue_union({"x": F.lit(True), "y": F.lit(None).cast("boolean")}, {"x": F.lit(False), "y": F.lit(True)})
    assert tuple(spark.range(1).select(both["x"], both["y"], added).first()) == (True, True, ["y"])
    done = spark.createDataFrame([(1, "s", "i", 0.5, "r", False, "G", "")], "request_id long, state string, intent string, confidence double, reply string, escalate boolean, reason string, reason_text string")
    assert respond.finalized(done, "agent").first().system == "agent"
    with pytest.raises(Exception, match="unfinished row"):
        respond.finalized(done.withColumn("state", F.lit(None).cast("string")), "agent").collect()


def test_prompts(spark):
    turn, ev = "array<struct<role:string,text:string>>", "array<struct<record_id:long,sim:double,asked:string,replied:string>>"
    rows = spark.createDataFrame([("m", [("customer", "hi")], [(7, 0.5, "q", "a")], ["too_long"]), ("m", [], [], [])], f"m string, t {turn}, e {ev}, x array<string>")
    full, bare = [r[0] for r in rows.select(prompts.draft_prompt(*(F.col(c) for c in "mtex"))).collect()]
    assert "customer: hi" in full and "[7] likeness 0.50" in full and "* too_long" in full
    assert "No turns before" in bare and "Nothing similar" in bare and "FAILED" not in bare
    assert rows.select(prompts.routing_prompt(F.col("m"), F.col("t"))).first()[0].startswith("EARLIER TURNS\n\ncustomer: hi")
    blank = spark.createDataFrame([([(7, 0.5, " ", "a")],)], f"e {ev}")
    with pytest.raises(Exception, match="blank evidence"):
        blank.select(prompts.evidence_block(F.col("e"))).collect()
    assert prompts.codebook([{"name": "a", "definition": "d", "include": ["x", "y"]}], "KINDS") == "KINDS\na = d\n  include: x / y"


def test_small_text_functions(spark):
    row = spark.range(1).select(
        T.cell(F.lit("a|b\nc"), 4).alias("cut"), T.cell(F.lit("a|b\nc")).alias("cell"), T.odd_characters(F.lit("a\té 😀")).alias("odd"),
        T.outer_json(F.lit('x {"a": {"b": 1}} y')).alias("json"), T.outer_json(F.lit("none")).alias("no"),
        T.rate_limit(F.lit("Rate limit reached on tokens per day (TPD), try again in 1h0m0s")).alias("day"),
        T.rate_limit(F.lit("try again in 7.5s.")).alias("minute"), T.rate_limit(F.lit("rate limit")).alias("bare"), T.rate_limit(F.lit("bad key")).alias("other"),
    ).first()
    assert (row.cut, row.cell, row.odd) == ("a\\|…", "a\\|b c", ["U+00E9", "U+00A0", "U+1F600"])
    assert (row.json, row.no, row.other) == ('{"a": {"b": 1}}', None, None)
    assert (tuple(row.day), tuple(row.minute), tuple(row.bare)) == (("tokens_per_day", 1820.0), ("tokens_per_minute", 12.5), ("tokens_per_minute", 75.0))


def test_sheet_with_bad_bytes_and_lock(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_bytes("id,note\n1,é\n".encode())
    bad.write_bytes(b"id,note\n1,a\xa0b\n2,\n")
    sheet, problems = stores.load_sheet(spark, str(bad))
    assert [tuple(r) for r in sheet.orderBy("id").collect()] == [("1", "a�b"), ("2", "")] and problems.count() == 1
    assert stores.load_sheet(spark, str(good))[1].count() == 0
    stores.check_lock(spark, str(good), hashlib.sha256(good.read_bytes()).hexdigest())
    with pytest.raises(ValueError, match="lock"):
        stores.check_lock(spark, str(bad), hashlib.sha256(good.read_bytes()).hexdigest())


def test_response_store(spark, tmp_path):
    path = str(tmp_path / "store")
    for rows in ([("a", "1", "{}"), ("b", "2", "{}")], [("a", "3", "{}")]):
        stores.put_responses(spark.createDataFrame(rows, "key string, value string, meta string"), path)
    store = stores.responses(spark, path)
    asked = spark.createDataFrame([("a",), ("c",)], "key string")
    assert {r.key: r.value for r in store.collect()} == {"a": "3", "b": "2"}
    assert {r.key: r.value for r in stores.cached(asked, store).collect()} == {"a": "3", "c": None}
    assert [r.key for r in stores.todo(asked, store).collect()] == ["c"]
    assert stores.cache_key({"b": 1, "a": 2}) == stores.cache_key({"a": 2, "b": 1}) != stores.cache_key({"a": 2})


def test_manifest_and_report(spark, tmp_path):
    path = tmp_path / "runs.json"
    path.write_text(json.dumps({"tokens": 5}))
    assert stores.append_run(str(path), {"tokens": 0}) == {"runs": [{"tokens": 5}, {"tokens": 0}]}
    assert len(stores.append_run(str(path), {"tokens": 1})["runs"]) == 3
    report = str(tmp_path / "r.md")
    text = stores.write_report(report, [stores.markdown(spark.createDataFrame([("x|y", 1)], "a string, n long"))], "note")
    assert "| x\\|y | 1 |" in text and "\nnote\n" in text
    (tmp_path / "r.md").write_text(text.replace("note", "by hand"))
    assert "by hand" in stores.write_report(report, ["new"], "note") and "x\\|y" not in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError, match="rows"):
        stores.markdown(spark.range(5), 3)

"""Reply threads: roots by pointer doubling, exchanges, anchored replies, merged messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.sources.tables import cut

#: Minutes between parts of one message, rounds of parts, minutes of context, turns of context.
MERGE_MINUTES, PART_ROUNDS, CONTEXT_MINUTES, CONTEXT_TURNS = 15, 4, 7 * 24 * 60, 3


def thread_roots(messages: DataFrame, rounds: int = 64) -> DataFrame:
    """tweet_id, root, orphan of each message (tweet_id, parent), by pointer doubling: the number of rounds grows with
    the logarithm of the deepest thread. orphan: has a parent that isn't in the data."""
    ids = messages.select(F.col("tweet_id").alias("p"))
    up = messages.join(ids, messages.parent == ids.p, "left").select(
        "tweet_id", F.coalesce("p", "tweet_id").alias("root"), (F.col("parent").isNotNull() & F.col("p").isNull()).alias("orphan")
    )
    up = cut(up)
    for _ in range(rounds):
        above = up.select(F.col("tweet_id").alias("root"), F.col("root").alias("higher"))
        new = cut(up.join(above, "root").select("tweet_id", F.col("higher").alias("root"), "orphan", (F.col("higher") != F.col("root")).alias("moved")))
        done = new.filter("moved").isEmpty()
        up = new.drop("moved")
        if done:
            break
    return up


def exchanges(messages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """record_id, conv_id, first_id, n_customer_parts, is_followup, reply_id, n_reply_parts, reply_delay, next_text: one row
    for each customer message that the brand answered, all parts of the answer together.

    messages: tweet_id, parent, conv_id, author, inbound, created (minutes), text. reply_id is the answer's first part. A message
    is a follow-up if what it answers, behind its own earlier parts, is an outbound message that answers a message in the data.
    next_text: the same customer's earliest answer to any part.
    """
    m = messages
    parts = anchored(m) if parts is None else parts
    one = F.struct("created", "depth", F.col("part_number"), F.col("tweet_id").alias("id"))
    numbered = parts.join(m.select("tweet_id", T.part_number(F.col("text")).alias("part_number")), "tweet_id")
    replies = numbered.groupBy("anchor").agg(F.min(one).alias("first"), F.count("*").alias("n_reply_parts"))
    asked = m.select(F.col("tweet_id").alias("anchor"), "conv_id", F.col("author").alias("customer"), F.col("created").alias("asked"))
    answers = m.filter("inbound and parent is not null").select(F.col("parent").alias("part"), "author", "created", "tweet_id", "text")
    after = (
        answers.join(parts.select(F.col("tweet_id").alias("part"), "anchor"), "part")
        .join(asked.select("anchor", "customer"), "anchor").filter("author = customer")
        .groupBy("anchor").agg(F.min_by("text", F.struct("created", "tweet_id")).alias("next_text"))
    )
    firsts = merged_messages(m).withColumnRenamed("tweet_id", "anchor")
    up = m.select(F.col("tweet_id").alias("first_id"), F.col("parent").alias("before"))
    before = m.select(F.col("tweet_id").alias("before"), F.col("inbound").alias("b_in"), F.col("parent").alias("b_up"))
    there = m.select(F.col("tweet_id").alias("b_up"), F.lit(True).alias("b_there"))
    rows = replies.join(asked, "anchor").join(firsts, "anchor").join(after, "anchor", "left").join(up, "first_id")
    rows = rows.join(before, "before", "left").join(there, "b_up", "left")
    return rows.select(
        F.col("anchor").alias("record_id"), "conv_id", "first_id", F.col("n_parts").alias("n_customer_parts"),
        F.coalesce(~F.col("b_in") & F.col("b_there"), F.lit(False)).alias("is_followup"),
        F.col("first.id").alias("reply_id"), "n_reply_parts", (F.col("first.created") - F.col("asked")).alias("reply_delay"), "next_text",
    )


def anchored(messages: DataFrame, rounds: int = PART_ROUNDS) -> DataFrame:
    """tweet_id, anchor, depth of outbound messages: an outbound answer to an inbound message is anchored there; one that
    answers an anchored message within 15 minutes inherits the anchor. Bounded rounds, a join each."""
    out = messages.filter("not inbound").select("tweet_id", "parent", "created")
    heads = messages.filter("inbound").select(F.col("tweet_id").alias("anchor"))
    known = level = cut(out.join(heads, out.parent == heads.anchor).select("tweet_id", "anchor", F.lit(0).alias("depth"), "created"))
    for i in range(1, rounds + 1):
        above = level.select(F.col("tweet_id").alias("a_id"), "anchor", F.col("created").alias("a_at"))
        near = (F.col("parent") == F.col("a_id")) & (F.col("created") - F.col("a_at") <= MERGE_MINUTES)
        # written, as the levels above and the caller read it again
        level = cut(out.join(above, near).select("tweet_id", "anchor", F.lit(i).alias("depth"), "created"))
        known = known.unionByName(level)
        if level.isEmpty():
            break
    return known


def merged_replies(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """anchor, n_parts, merged: the parts of each reply joined by created, depth, split marker and id."""
    rows = parts.join(messages.select("tweet_id", "text"), "tweet_id").withColumn("number", T.part_number(F.col("text")))
    one = F.struct("created", "depth", "number", "tweet_id", "text")
    return rows.groupBy("anchor").agg(F.array_sort(F.collect_list(one)).alias("p")).select(
        "anchor", F.size("p").alias("n_parts"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("merged")
    )


def message_parts(messages: DataFrame, most: int = 5) -> DataFrame:
    """tweet_id, first_id, ids (oldest first) of the last part of each customer message: walk up while the parent is by the same
    author, inbound, not answered by the brand itself and at most 15 minutes older; five parts at most."""
    m = messages.filter("inbound").select("tweet_id", "parent", "author", "created")
    answered = messages.filter("not inbound and parent is not null").select(F.col("parent").alias("tweet_id")).distinct()
    last = m.join(answered, "tweet_id", "left_semi").select("tweet_id", "author", F.array("tweet_id").alias("ids"), F.col("parent").alias("up"), F.col("created").alias("at"))
    free = m.join(answered, "tweet_id", "left_anti").select(F.col("tweet_id").alias("f_id"), F.col("parent").alias("f_up"), F.col("author").alias("f_author"), F.col("created").alias("f_at"))
    for _ in range(most - 1):
        fits = (F.col("up") == F.col("f_id")) & (F.col("author") == F.col("f_author")) & (F.col("at") - F.col("f_at") <= MERGE_MINUTES)
        more = F.col("f_id").isNotNull()
        last = last.join(free, fits, "left").select(
            "tweet_id", "author", F.when(more, F.concat(F.array("f_id"), "ids")).otherwise(F.col("ids")).alias("ids"),
            F.when(more, F.col("f_up")).alias("up"), F.coalesce("f_at", "at").alias("at"),
        )
    return last.select("tweet_id", F.get("ids", F.lit(0)).alias("first_id"), "ids")


def merged_messages(messages: DataFrame, most: int = 5) -> DataFrame:
    """tweet_id, first_id, n_parts of the last part of each customer message, as in ``message_parts``."""
    return message_parts(messages, most).select("tweet_id", "first_id", F.size("ids").alias("n_parts"))


def prior_counts(rows: DataFrame, who: str, thread: str, at: Column) -> DataFrame:
    """Each customer's threads with the number of earlier ones: the first message of a thread counts."""
    first = rows.groupBy(who, thread).agg(F.min(at).alias("start"))
    return first.withColumn("prior", F.row_number().over(W.partitionBy(who).orderBy("start", thread)) - 1)


def answered(messages: DataFrame, canned_from: int = 5) -> DataFrame:
    """record_id, conv_id, reply, n_parts, all_canned, action, dm, customer_text, is_followup, language, clean, n_words, letters, next_id,
    next_text, created: the plain exchanges that brands are compared by, a row for each customer message that the brand answered.

    messages as for ``exchanges``. A reply is up to four parts, by time and id; it is canned if the letters of each of its parts are those of
    ``canned_from`` outbound messages or more, and not none. A message is a follow-up if it answers an outbound one. next: the
    same customer's earliest answer to any part. Null texts are empty.
    """
    m = messages.withColumn("text", F.coalesce("text", F.lit("")))
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    said = m.filter("not inbound").select("tweet_id", "text", key.alias("key"))
    often = said.groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") >= canned_from) & (F.col("key") != ""))
    said = said.join(often, "key", "left").select("tweet_id", F.col("text").alias("part_text"), F.col("n").isNotNull().alias("canned"))
    parts = anchored(m, 3)
    part = F.struct("created", "tweet_id", "part_text")
    replies = parts.join(said, "tweet_id").groupBy("anchor").agg(
        F.array_sort(F.collect_list(part)).alias("p"), F.every("canned").alias("all_canned")  # at most what answers one message
    )
    asked = m.select(F.col("tweet_id").alias("anchor"), "conv_id", F.col("author").alias("customer"), F.col("parent").alias("before"), F.col("text").alias("customer_text"), F.col("created").alias("asked_at"))
    answers = m.filter("inbound and parent is not null").select(F.col("parent").alias("part"), "author", "created", "tweet_id", "text")
    after = answers.join(parts.select(F.col("tweet_id").alias("part"), "anchor"), "part").join(asked.select("anchor", "customer"), "anchor").filter("author = customer")
    after = after.groupBy("anchor").agg(F.min(F.struct("created", "tweet_id", "text")).alias("next"))
    above = m.filter("not inbound").select(F.col("tweet_id").alias("before"), F.lit(True).alias("follows"))
    rows = replies.join(asked, "anchor").join(after, "anchor", "left").join(above, "before", "left")
    reply = F.array_join(F.transform("p", lambda x: x["part_text"]), " ")
    clean = F.regexp_replace(F.regexp_replace(F.lower("customer_text"), T.URL, " "), T.MENTION, " ")
    rows = rows.withColumns({"reply": reply, "clean": F.trim(F.regexp_replace(clean, r"\s+", " "))})
    letters = F.trim(F.regexp_replace(F.regexp_replace("clean", "[^a-z ]+", " "), r"\s+", " "))
    return rows.select(
        F.col("anchor").alias("record_id"), "conv_id", "reply", F.size("p").cast("long").alias("n_parts"), "all_canned",
        F.lower("reply").rlike(T.ACTION).alias("action"), F.lower("reply").rlike(T.DM_REDIRECT).alias("dm"), "customer_text",
        F.coalesce("follows", F.lit(False)).alias("is_followup"), T.language(F.lower("customer_text")).alias("language"), "clean",
        F.size(F.regexp_extract_all("clean", F.lit("[a-z]{2,}"), F.lit(0))).cast("long").alias("n_words"), letters.alias("letters"),
        F.col("next.tweet_id").alias("next_id"), F.col("next.text").alias("next_text"), F.col("asked_at").alias("created"),
    )


def waterfall(rows: DataFrame, least_words: int = 3) -> DataFrame:
    """step, kept: rows of ``answered`` left after each step: not foreign, ``least_words`` words, no hand-off to direct messages, the earliest of
    those with equal letters. All steps are there, also without rows."""
    hand_off = F.col("clean").rlike(T.DM_LOGISTICS) & (F.col("n_words") < 8)
    passed = F.when(F.col("language") == "other", 0).when(F.col("n_words") < least_words, 1).when(hand_off, 2).otherwise(3)
    counts = rows.withColumn("passed", passed).groupBy("letters", "passed").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.when(F.col("passed") == 3, 1).otherwise(0))  # one of each letters stays
    names = ["answered", "not_foreign", "enough_words", "no_hand_off", "first_of_equals"]
    kept = [F.sum(F.when(F.col("passed") >= i, F.col("n")).otherwise(0)) for i in range(4)] + [F.sum("first")]
    sums = counts.agg(F.array(*(F.struct(F.lit(k).alias("step"), F.coalesce(c, F.lit(0)).cast("long").alias("kept")) for k, c in zip(names, kept, strict=True))).alias("s"))
    return sums.select(F.inline("s"))

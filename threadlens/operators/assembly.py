"""The record table: exchanges with split, leakage, weak labels and evidence, in fixed columns; and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import context, quantiles, retrieval, threads
from threadlens.sources.tables import cut

# The columns in their order, those that only the train split has, and the threshold of near-duplicates.
COLUMNS = [
    "record_id", "thread_id", "thread_started_at", "split", "created_at", "customer_id", "customer_prior_threads", "is_followup", "context",
    "context_turns", "context_truncated", "customer_tweet_ids", "n_customer_parts", "customer_text", "customer_text_clean", "lang", "n_words",
    "customer_escalation_signals", "reply_tweet_ids", "n_reply_parts", "brand_reply", "brand_reply_clean", "reply_created_at", "reply_delay_min",
    "reply_type", "reply_is_canned", "reply_template", "retrieval_eligible", "max_train_similarity", "eval_eligible", "reply_template_in_train",
    "next_customer_text", "weak_outcome", "outcome_confidence", "weak_outcome_source", "brand_escalation_evidence",
]
TRAIN_ONLY = ["next_customer_text", "weak_outcome", "outcome_confidence", "weak_outcome_source", "brand_escalation_evidence"]
NEAR_DUPLICATE = 0.95
#: What ``reported`` reads of the records.
REPORTED = ["record_id", "thread_id", "thread_started_at", "created_at", "customer_id", "is_followup", "reply_type", "customer_text_clean"]


def _codes(masks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(m, F.lit(k)) for k, m in masks.items())))


def customer_signals(text: Column, prior_threads: Column) -> Column:
    """Names of the weak cues of a customer's message, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _codes({
        "anger": low.rlike(T.ANGER), "legal_threat": low.rlike(T.LEGAL), "security": low.rlike(T.SECURITY),
        "billing_dispute": low.rlike(T.BILLING_DISPUTE), "repeat_contact_cue": low.rlike(T.REPEAT_CONTACT), "prior_contact": prior_threads >= 1,
    })


def brand_evidence(reply: Column) -> Column:
    """What a reply did, in order."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    return _codes({"dm_request": low.rlike(T.DM_REDIRECT), "handoff_other_channel": low.rlike(T.HANDOFF), "policy_enforcement": low.rlike(T.POLICY)})


def splits(started: Column, created: Column, at: Column) -> Column:
    return F.when(started >= at, "holdout").when(created < at, "train").otherwise("excluded")


def suggested_cut(records: DataFrame, train_share: float = 0.7) -> DataFrame:
    """One row: cut, the day's start (of thread_started_at in seconds) that leaves about ``train_share`` of the records before it."""
    found = quantiles.exact(records, "thread_started_at", [train_share])
    return found.agg((F.floor(F.max("value") / 86400) * 86400).alias("cut"))


def canned(messages: DataFrame, least: int = 5) -> DataFrame:
    """tweet_id, template, canned of outbound messages: a template that its author uses often and that has words."""
    keyed = messages.filter("not inbound").select("tweet_id", "author", T.template_key(F.lower("text")).alias("template"))
    used = keyed.groupBy("author", "template").agg(F.count("*").alias("n"))
    return keyed.join(used, ["author", "template"]).select("tweet_id", "template", ((F.col("n") >= least) & (F.col("template") != "")).alias("canned"))


def exchange_records(messages: DataFrame, brand: str = "brand") -> DataFrame:
    """The exchanges of ``messages`` (tweet_id, parent, conv_id, author, inbound, created in minutes, text) with their context, texts
    as they are and cleaned, language, words, reply type and template, and earlier threads of the customer: what ``assemble``
    starts from. brand: the author whose replies these are. Times are in seconds, those of the context's turns ISO minutes.
    """
    parts = cut(threads.anchored(messages))
    said = messages.select("tweet_id", "text")
    by_part = lambda field, by: F.array_join(F.transform("p", lambda x: x[field]), by)

    one = F.struct("created", "depth", T.part_number(F.col("text")).alias("number"), "tweet_id", "text", T.clean_brand_part(F.col("text")).alias("clean"), "template", "canned")
    replies = parts.join(said, "tweet_id").join(canned(messages), "tweet_id").groupBy("anchor").agg(F.array_sort(F.collect_list(one)).alias("p"))
    replies = cut(replies.select(
        F.col("anchor").alias("record_id"), F.transform("p", lambda x: x["tweet_id"]).alias("reply_tweet_ids"), by_part("text", " ").alias("brand_reply"),
        by_part("clean", " ").alias("brand_reply_clean"), by_part("template", " | ").alias("reply_template"),
        F.forall("p", lambda x: x["canned"]).alias("reply_is_canned"), (F.get("p", F.lit(0))["created"] * 60).alias("reply_created_at"),
    ))
    own = threads.message_parts(messages).select(F.col("tweet_id").alias("record_id"), F.col("ids").alias("customer_tweet_ids"))
    each = own.select("record_id", F.posexplode("customer_tweet_ids").alias("pos", "tweet_id")).join(said, "tweet_id")
    texts = each.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", T.clean_customer(F.col("text")).alias("clean")))).alias("p"))
    texts = texts.select("record_id", by_part("text", " ").alias("customer_text"), by_part("clean", " ").alias("customer_text_clean"))

    at = messages.select(F.col("tweet_id").alias("record_id"), F.col("author").alias("customer_id"), (F.col("created") * 60).alias("created_at"))
    roots = threads.thread_roots(messages).select(F.col("tweet_id").alias("record_id"), F.col("root").alias("thread_id"))
    starts = messages.select(F.col("tweet_id").alias("thread_id"), (F.col("created") * 60).alias("thread_started_at"))
    rows = threads.exchanges(messages, parts).drop("conv_id").join(at, "record_id").join(roots, "record_id").join(starts, "thread_id")
    rows = cut(rows.join(replies, "record_id").join(own, "record_id").join(texts, "record_id"))

    chain = cut(context.chains(messages, rows.select("record_id", "first_id")))
    clean = F.when(F.col("inbound"), T.clean_customer(F.col("text"))).otherwise(T.clean_brand_part(F.col("text")))
    shown = replies.select(F.col("record_id").alias("anchor"), F.col("brand_reply_clean").alias("merged"))
    turns = context.context_turns(messages.withColumn("text", clean), rows.select("record_id", "first_id", F.col("customer_id").alias("customer")), parts, shown, brand, chain=chain)
    turn = F.struct("turn_no", "role", "text", T.iso_minutes(F.timestamp_seconds(F.col("created") * 60)).alias("created_at"))
    turns = turns.groupBy("record_id").agg(F.array_sort(F.collect_list(turn)).alias("c"), F.bool_or("truncated").alias("shortened"))
    turns = turns.select("record_id", F.transform("c", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["created_at"].alias("created_at"))).alias("context"), "shortened")
    stale = chain.filter("step = 0").select("record_id", "stale")
    rows = rows.join(stale, "record_id").join(turns, "record_id", "left")
    none = F.array().cast("array<struct<role:string,text:string,created_at:string>>")

    prior = threads.prior_counts(rows, "customer_id", "thread_id", F.col("created_at")).select("customer_id", "thread_id", F.col("prior").alias("customer_prior_threads"))
    low = F.lower("customer_text")
    body = T.collapse(F.regexp_replace(F.regexp_replace(low, T.URL, " "), T.MENTION, " "))
    guides, dm = T.has_guidance(F.col("brand_reply_clean")), F.lower("brand_reply").rlike(T.DM_REDIRECT)
    kind = F.when(guides & ~F.col("reply_is_canned"), "substantive").when(dm & ~guides, "dm_deflection").otherwise("other")
    return rows.join(prior, ["customer_id", "thread_id"]).withColumns({
        "lang": T.language(low), "n_words": F.regexp_count(body, F.lit("[a-z]{2,}")), "body": body,
        "reply_type": kind, "reply_delay_min": F.round("reply_delay", 1), "next_customer_text": F.col("next_text"),
        "context": F.coalesce("context", none), "context_turns": F.coalesce(F.size("context"), F.lit(0)),
        "context_truncated": F.col("stale") | F.coalesce("shortened", F.lit(False)),
    })


def _split(records: DataFrame, at: float) -> tuple[DataFrame, Column, Column, list[DataFrame]]:
    """The records with their split, its conditions, and the texts (id, text) of the train and the holdout split."""
    rows = records.withColumn("split", splits(F.col("thread_started_at"), F.col("created_at"), F.lit(at)))
    train, holdout = F.col("split") == "train", F.col("split") == "holdout"
    return rows, train, holdout, [rows.filter(s).select(F.col("record_id").alias("id"), F.col("customer_text_clean").alias("text")) for s in (train, holdout)]


def reported(records: DataFrame, at: float) -> DataFrame:
    """What ``split_report`` reads of the record table, of REPORTED columns of ``exchange_records``: holdout texts near a training text are
    found as such, without the best cosine of every text."""
    rows, train, holdout, sides = _split(records, at)
    near = retrieval.near(*sides, NEAR_DUPLICATE).select(F.col("id").alias("record_id"), F.lit(True).alias("near"))
    return rows.join(near, "record_id", "left").withColumns({
        "retrieval_eligible": train & (F.col("reply_type") == "substantive"), "eval_eligible": holdout & F.col("near").isNull(),
    }).drop("near", "customer_text_clean")


def assemble(records: DataFrame, at: float) -> DataFrame:
    """The record table: COLUMNS of ``exchange_records``, split at ``at`` (seconds). Similarity to training texts is given to 3
    digits but decided on in full; columns of TRAIN_ONLY are null outside the train split."""
    rows, train, holdout, sides = _split(records, at)
    like = retrieval.max_similarity(*sides)
    like = like.select(F.col("id").alias("record_id"), F.col("max_sim"))
    used = rows.filter(train).filter("reply_template <> ''").select("reply_template", F.lit(True).alias("in_train")).distinct()
    rows = rows.join(like, "record_id", "left").join(used, "reply_template", "left")
    outcome, sure = T.weak_outcome(F.col("next_customer_text"), F.col("reply_type"))
    rows = rows.withColumns({
        "retrieval_eligible": train & (F.col("reply_type") == "substantive"),
        "max_train_similarity": F.round("max_sim", 3),
        "eval_eligible": holdout & (F.coalesce("max_sim", F.lit(1.0)) < NEAR_DUPLICATE),
        "reply_template_in_train": holdout & F.coalesce("in_train", F.lit(False)),
        "customer_escalation_signals": customer_signals(F.col("customer_text"), F.col("customer_prior_threads")),
        "weak_outcome": outcome, "outcome_confidence": sure, "weak_outcome_source": F.lit("heuristic_v1"),
        "brand_escalation_evidence": brand_evidence(F.col("brand_reply")),
    })
    return rows.select(*(F.when(train, F.col(c)).alias(c) if c in TRAIN_ONLY else F.col(c) for c in COLUMNS))


def split_report(records: DataFrame) -> DataFrame:
    """split, n, threads, customers, followups, substantive, eligible for retrieval and evaluation, first and last time."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return records.groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("customer_id").alias("customers"),
        yes(F.col("is_followup"))("followups"), yes(F.col("reply_type") == "substantive")("substantive"), yes(F.col("retrieval_eligible"))("retrieval_eligible"),
        yes(F.col("eval_eligible"))("eval_eligible"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def grounding_corpus(records: DataFrame) -> DataFrame:
    """The records that may be retrieved: substantive replies of the train split."""
    return records.filter((F.col("split") == "train") & F.col("retrieval_eligible"))


def shared_threads(records: DataFrame) -> DataFrame:
    """Threads that are in train and holdout both; none should be."""
    sides = records.filter(F.col("split").isin("train", "holdout")).groupBy("thread_id").agg(F.count_distinct("split").alias("n"))
    return sides.filter("n > 1").select("thread_id")

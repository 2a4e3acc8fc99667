"""Context of a message: the chain of earlier messages, folded into turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.operators.threads import CONTEXT_MINUTES, CONTEXT_TURNS
from threadlens.sources.tables import cut

#: Fixed value: ancestors looked at.
CHAIN = 50


def ancestors(messages: DataFrame, most: int = CHAIN) -> DataFrame:
    """tweet_id, created, up: the nearest ``most`` ancestors (id, at) of each message, nearest first.

    messages: tweet_id (distinct), parent, created. By doubling: a list of 2^k ancestors goes on with that of its last one, so
    50 ancestors take six joins on the distinct id, fewer where threads are short. Messages whose chain has ended leave
    the joins.
    """
    m = messages.select("tweet_id", "parent", "created")
    above = m.select(F.col("tweet_id").alias("parent"), F.array(F.struct(F.col("tweet_id").alias("id"), F.col("created").alias("at"))).alias("up"))
    none = F.array().cast(above.schema["up"].dataType)
    heads = m.filter("parent is null").select("tweet_id", "created", none.alias("up"))
    answers = m.filter("parent is not null").join(above, "parent", "left").select("tweet_id", "created", F.coalesce("up", none).alias("up"))
    table, reach = cut(heads.unionByName(answers)), 1
    while reach < most and not table.filter(F.size("up") == reach).isEmpty():
        on = table.filter(F.size("up") == reach).withColumn("top", F.element_at("up", -1)["id"])
        more = table.select(F.col("tweet_id").alias("top"), F.col("up").alias("more"))
        longer = on.join(more, "top").select("tweet_id", "created", F.concat("up", "more").alias("up"))
        table, reach = cut(table.filter(F.size("up") < reach).unionByName(longer)), 2 * reach
    return table.withColumn("up", F.slice("up", 1, most))


def chains(messages: DataFrame, records: DataFrame, most: int = CHAIN, minutes: int = CONTEXT_MINUTES) -> DataFrame:
    """record_id, step, tweet_id, stale: the ancestors of each record's first message, nearest first (step 1), at most
    ``most`` of them, up to the first that is over ``minutes`` older; and a row of step 0 without tweet_id for each record.
    stale, alike on all rows of a record: an ancestor was left out for its age.

    messages: tweet_id (distinct), parent, created (minutes); records: record_id, first_id.
    """
    own = records.select("record_id", F.col("first_id").alias("tweet_id")).join(ancestors(messages, most), "tweet_id")
    old = F.array_position(F.transform("up", lambda x: F.col("created") - x["at"] > minutes), True)
    own = own.withColumn("old", old)
    kept = F.when(F.col("old") > 0, F.slice("up", F.lit(1), F.greatest(F.col("old") - 1, F.lit(0)).cast("int"))).otherwise(F.col("up"))
    ids = F.concat(F.array(F.lit(None).cast(messages.schema["tweet_id"].dataType)), F.transform(kept, lambda x: x["id"]))
    return own.select("record_id", F.posexplode(ids).alias("step", "tweet_id"), (F.col("old") > 0).alias("stale"))


def role(author: Column, inbound: Column, customer: Column, brand: Column) -> Column:
    """customer, brand, other_customer or other_brand."""
    known = F.when(author == customer, "customer").when(author == brand, "brand")
    return known.when(inbound, "other_customer").otherwise("other_brand")


def context_turns(messages: DataFrame, records: DataFrame, parts: DataFrame, replies: DataFrame, brand: str, most: int = CONTEXT_TURNS, chain: DataFrame | None = None) -> DataFrame:
    """record_id, turn_no, role, created, text, truncated: the turns before each record, oldest first.

    Messages by one author that follow each other are one turn. A reply in several parts is shown whole where its first part
    in the chain stands, and its other parts are passed over. Of more than ``most`` turns the first and the last ones stay.
    truncated: turns or older messages are left out. Records without context have no rows.

    messages: tweet_id, parent, author, inbound, created, text (cleaned); records: record_id, first_id, customer;
    parts: tweet_id, anchor; replies: anchor, merged; chain: that of the records, if it is known. A record has at most 50 rows
    in a window.
    """
    chain = chains(messages, records.select("record_id", "first_id")) if chain is None else chain
    chain = chain.filter("tweet_id is not null")
    said = messages.select("tweet_id", "author", "inbound", "created", "text")
    rows = (
        chain.join(said, "tweet_id")
        .join(parts.select("tweet_id", "anchor"), "tweet_id", "left")
        .join(replies.select("anchor", "merged"), "anchor", "left")
        .join(records.select("record_id", "customer"), "record_id")
    )
    oldest = F.desc("step")
    unit = F.struct(F.col("anchor").isNotNull().alias("reply"), F.coalesce("anchor", "tweet_id").alias("id"))
    rows = rows.withColumn("unit", unit).withColumn("nth", F.row_number().over(W.partitionBy("record_id", "unit").orderBy(oldest)))
    rows = rows.filter("nth = 1").withColumn("piece", F.when(F.col("unit.reply"), F.col("merged")).otherwise(F.col("text")))
    order = W.partitionBy("record_id").orderBy(oldest)
    new = ~F.col("author").eqNullSafe(F.lag("author").over(order)) | (F.row_number().over(order) == 1)
    rows = rows.withColumn("new", new.cast("int")).withColumn("turn", F.sum("new").over(order))
    one = F.struct((-F.col("step")).alias("o"), "piece", "author", "inbound", "created")
    turns = rows.groupBy("record_id", "customer", "turn", "stale").agg(F.array_sort(F.collect_list(one)).alias("p"))
    head = F.col("p")[0]
    turns = turns.select(
        "record_id", "turn", "stale", F.count("*").over(W.partitionBy("record_id")).alias("n"),
        role(head["author"], head["inbound"], F.col("customer"), F.lit(brand)).alias("role"),
        head["created"].alias("created"), F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"),
    )
    kept = turns.filter((F.col("n") <= most) | (F.col("turn") == 1) | (F.col("turn") > F.col("n") - (most - 1)))
    return kept.select(
        "record_id", F.row_number().over(W.partitionBy("record_id").orderBy("turn")).cast("long").alias("turn_no"), "role",
        "created", "text", (F.col("stale") | (F.col("n") > most)).alias("truncated"),
    )

"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written and
read again as the next stage's documents. Stages find rows again by a key of doc_id and a hash of the text, so repeated
doc_ids don't get mixed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import fair_mix, importance, pii, simhash, winnowing
from threadlens.llm.shared import fresh, own_columns, table, written


def _key() -> Column:
    return F.struct("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, with the key for doc_id."""
    return docs.select(_key().alias("doc_id"), *[c for c in ("text", "source") if c in docs.columns])


def _with_key(docs: DataFrame, name: str) -> DataFrame:
    return docs.select("*", _key().alias(name))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the importance sampler accepts."""
    model = importance.train(docs, importance.good_labels(table(spark, sf_dir, "labels")))
    return importance.accepted(model).select(*own_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that with the least doc_id. Of rows equal in doc_id and text, one stays."""
    key = fresh("key", docs)
    found = simhash.near_duplicates(_keyed(docs), simhash.FIVE_WORDS)
    keep = written(found.select(F.col("component").alias(key)).distinct(), "keep")
    rows = _with_key(docs, key).join(keep, key)
    return rows.dropDuplicates([key]).select(*own_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the benchmark contaminates."""
    key = fresh("key", docs)
    found = winnowing.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"))
    bad = found.filter(winnowing.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(key))
    bad = written(bad.distinct(), "contaminated")
    return _with_key(docs, key).join(bad, key, "left_anti").select(*own_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; n_chars follows the text."""
    found = fresh("personal_data", docs)
    text = pii.redacted("text", f"concat({found}.base, {found}.added)")
    new = {"text": F.when(F.col("text").isNotNull(), text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(new["text"]), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    rows = pii.with_spans(docs, into=found)
    return rows.select(*(new[c].alias(c) if c in new else own for c, own in zip(docs.columns, own_columns(docs), strict=True)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in the order of service, with two more columns: taken, the words taken of a document, and
    virtual_finish, in its first pass. Rows equal in doc_id and text share what is taken of them."""
    key, taken, finish = (fresh(n, docs) for n in ("key", "taken", "virtual_finish"))
    found = fair_mix.fair_mix(_keyed(docs)).groupBy(F.col("doc_id").alias(key)).agg(
        F.sum("taken").alias("all_taken"), F.count("*").alias("rows"), F.min("virtual_finish").alias(finish)
    )
    found = found.select(key, F.floor(F.col("all_taken") / F.col("rows")).alias(taken), finish)
    found = written(found.filter(F.col(taken) > 0), "mix")
    rows = _with_key(docs, key).join(found, key)
    return rows.orderBy(finish, key).select(*own_columns(docs), taken, finish)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: The stages hash and train models; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

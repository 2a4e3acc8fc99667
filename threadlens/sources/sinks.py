"""Writers: tables of fixed columns, JSON lines, CSV, and vectors with the ids they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, columns: list[str], by: list[str] | None = None) -> None:
    """Write Parquet with exactly these columns in this order, partitioned by some of them; raises for missing ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    writer = df.select(*(f"`{c}`" for c in columns)).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes doubled, line breaks kept inside quotes."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def save_vectors(rows: DataFrame, path: str, model: str) -> None:
    """Write id, vector with the name of the model and the vectors' length beside each, so that a reader can tell."""
    rows.select("id", "vector", F.lit(model).alias("model"), F.size("vector").alias("width")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, ids: DataFrame, model: str) -> DataFrame:
    """id, vector of all ids. Raises, saying what to do, where the store is missing, is another model's, has vectors of
    several lengths, or lacks ids."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:
        raise FileNotFoundError(f"no vectors at {path}; write them with save_vectors first") from error
    found = stored.agg(F.collect_set("model").alias("models"), F.collect_set("width").alias("widths")).first()
    if found.models and found.models != [model]:
        raise ValueError(f"vectors at {path} are of {found.models}, not {model}; write them again")
    if len(found.widths) > 1:
        raise ValueError(f"vectors at {path} have lengths {sorted(found.widths)}")
    missing = ids.select("id").join(stored.select("id"), "id", "left_anti").take(3)
    if missing:
        raise ValueError(f"no vectors for {[r.id for r in missing]} at {path}; write them again")
    return stored.join(ids.select("id"), "id", "left_semi").select("id", "vector")

"""Helpers that several operators use: shared storage, row ids, batches of words, Arrow output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of
    its own; on a cluster that is an error, as no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadlens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/threadlens-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{_own(spark)}/{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it again. Survives the loss of any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``written`` made in this application. DataFrames that still read them can't be used
    afterwards, so results are to be saved first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores behind it as no column of the frames needs more."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns as they are, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row, so that repeated doc_ids stay apart. Only stable once it is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column without decoding it; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def blocks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to about ``most``; a single larger row stands alone."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if end > start:
        yield start, end

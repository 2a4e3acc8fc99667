"""Every query with SQL for the checking engine, on the smallest tables; results at two partition counts."""

import duckdb
import pytest

from threadlens.plans import registry
from threadlens.sources.tables import NAMES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_checking_engine(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["exchange_pairs", "anchored_replies", "prior_sessions", "template_repeats", "topk_diverse"])
def test_partitions_do_not_matter(spark, name):
    first = rows(registry.QUERIES[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(registry.QUERIES[name](spark, SF).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_all_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry_imports_and_lists(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

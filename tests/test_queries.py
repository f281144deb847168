"""Every registered query against its DuckDB SQL on the driver's smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallyloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
    result = duck.execute(ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert mine == sorted(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_plans_push_down_and_prune(spark, sf_dir):
    plan = QUERIES["filter_time_range"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "props" not in plan
    assert "CartesianProduct" not in QUERIES["benchmark_phrases"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_phrases_anywhere(spark):
    from tallyloom.plans.retrieval import phrases

    items = [(1, "That and onesen of the many words"), (2, "one two, three four five"), (3, "word"), (4, "two words"), (5, "now then here"), (6, "a"), (7, "ab"), (8, ""), (9, None), (10, " led by space and more "), (11, "word"), (12, "é ü"), (13, "four words are here")]
    texts = [(1, 'he said ("That and onesen of the many words") now'), (2, "xone two, three four fivex"), (3, "swords, two wordsmiths"), (4, "now then here, and"), (5, ""), (6, None), (7, "ab"), (8, "x led by space and more y"), (8, "x led by space and more y"), (9, "That and\nonesen of the many words"), (10, "é üb"), (11, "(four words are here)"), (12, "a")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((d, i) for d, t in texts for i, x in items if t is not None and x is not None and x in t)
    assert sorted(map(tuple, phrases(docs, bench).collect())) == expected
    only_long = sorted((d, i) for d, i in expected if i in (1, 2, 10))
    assert sorted(map(tuple, phrases(docs, bench.where("item_id in (1, 2, 10)")).collect())) == only_long

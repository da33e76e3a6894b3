"""The stored buckets of nested documents: one shuffle, tasks of bounded input, and every order whatever its key."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from bramble import catalogue

LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_tax double"


@pytest.fixture
def odd(spark, tmp_path):
    """Orders 0 to 599 with none, three or four lines; one twice, two without a key; lines without an order or a key."""
    keys = [*range(600), 7, None, None]
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "o_orderkey bigint, o_custkey bigint").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, n, k, n, 42.0 + 2 * ((k + n) % 5), 2.0, 0.1, "R", 0.0) for k in range(600) if k % 3 for n in range(k % 3 + 2, 0, -1)]
    lines += [(k, 1, 1, 1, 1.0, 2.0, 0.1, "A", 0.0) for k in (-5, 1000, None, None)]
    spark.createDataFrame(lines, LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k % 50, k // 50, "user", f"t{k}") for k in range(300)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


@pytest.fixture
def exchanges(spark, monkeypatch):
    """The shuffles of each plan that is written; joins send no table, as if all were too large."""
    counts, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **options):
        counts.append(len(re.findall(r"\bExchange\b", self._df._jdf.queryExecution().executedPlan().toString())))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield counts
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("build", [catalogue.orders_doc, catalogue.conv_doc])
def test_nested_documents_are_stored_with_one_shuffle(spark, odd, exchanges, build):
    build(spark, odd)
    assert exchanges == [1]


@pytest.mark.parametrize("name", ["upd_positional_missing", "bql_array_any", "bql_size", "bql_in_null"])
def test_query_over_odd_keys_with_one_shuffle(spark, odd, exchanges, name):
    got = catalogue.QUERIES[name](spark, odd)
    assert exchanges == [1] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    want = duck.execute(catalogue.ORACLE_SQL[name]).fetchall()
    assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_every_order_is_nested_once_and_no_line_without_one(spark, odd):
    got = catalogue.orders_doc(spark, odd).table
    assert got.columns == ["o_orderkey", "o_custkey", "items"]
    want = [(k, i, None if k is None or k % 3 == 0 else [(n, k, n) for n in range(1, k % 3 + 3)]) for i, k in enumerate([*range(600), 7, None, None])]
    rows = [(r["o_orderkey"], r["o_custkey"], r["items"] and [(x["l_linenumber"], x["l_partkey"], x["l_suppkey"]) for x in r["items"]]) for r in got.collect()]
    assert sorted(rows, key=lambda r: r[1]) == want


def test_more_bytes_are_dealt_to_more_tasks_in_disjoint_sorted_ranges(spark, odd, monkeypatch):
    monkeypatch.setattr(catalogue, "NEST_BYTES", 2000)
    got = catalogue.orders_doc(spark, odd).table.where("o_orderkey IS NOT NULL")
    files = got.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("o_orderkey").alias("keys")).collect()
    keys = sorted(r["keys"] for r in files)
    assert len(files) > 4
    assert [k for part in keys for k in part] == sorted([*range(600), 7])

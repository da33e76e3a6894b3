"""Exact dedup against SQL and against brute force on awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bramble.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests.llm.conftest import ROWS

LAST = 2**63


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), LAST if i is None else i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(LAST if i == LAST else i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out), len(groups)


def found(df):
    rows = df.collect()
    none = lambda x: LAST if x is None else x
    return sorted((none(r.doc_id), none(r.keep_id), r.group_size, r.text_sha256) for r in rows), sum(r.kept for r in rows)


def test_awkward_rows(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    assert found(exact_duplicates(docs)) == brute([(i, t) for i, t, _, _ in ROWS])


def with_partitions(spark, n, run):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("partitions", [1, 2, 16])
def test_groups_over_many_partitions(spark, partitions):
    """Groups that hold most rows, so that splitters cut them again and again, one of them without ids."""
    rows = [(i, "copy of one text" + " " * (i % 4) if i % 3 else f"text {i % 7}") for i in range(3000)]
    rows += [(None, "no id") for _ in range(1500)] + [(i % 5, "copy of one text, and more") for i in range(1000)]
    random.Random(partitions).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert with_partitions(spark, partitions, lambda: found(exact_duplicates(docs))) == brute(rows)


def test_order_is_that_of_whole_texts(spark):
    """Texts that share a long beginning, and one that begins another, are told apart at their ends."""
    head = "same beginning " * 40
    rows = [(i, head + "x" * (i % 50) + str(i % 2)) for i in range(2000)] + [(i, head) for i in range(2000, 2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert with_partitions(spark, 12, lambda: found(exact_duplicates(docs))) == brute(rows)


def test_largest_id_is_an_id(spark):
    rows = [(2**63 - 1, "a"), (None, "a "), (None, "b"), (2**63 - 1, "b")]
    got = {(r.doc_id, r.text_sha256): r.keep_id for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {2**63 - 1, None} and got[2**63 - 1, hashlib.sha256(b"a").hexdigest()] is None  # more code points first


def test_drop_keeps_columns_and_one_row(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 6, 7, 8, 9, 10] and ids.count(None) == 1


def test_drop_on_repeated_and_null_ids(spark):
    """Distinct texts under one id stay; copies without an id, or under one id, go."""
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "d"), (2, "d "), (2, "d"), (3, "d"), (4, None), (None, " "), (None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tags", F.create_map(F.lit("k"), F.col("text")))
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a"), (1, "b"), (None, "c"), (2, "d "), (None, " "), (None, "e")], key=str)


def test_empty(spark, empty_tables):
    assert exact_duplicates(spark.read.parquet(f"{empty_tables}/documents.parquet")).count() == 0

"""The filter language: errors, round trips, and compiled columns against the evaluator."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bramble.plans import bql, evaluator
from bramble.plans.compiler import Compiler
from bramble.plans.dynamic import DynamicCompiler
from bramble.plans.normalize import normalize

BAD = ['{"a":{"$gt":null}}', '{"a":{}}', '{"a":{"$foo":1}}', '{"$foo":1}', '{"a":{"$size":1.5}}', '{"a":{"$size":5000000000}}', '{"a":{"$exists":1}}', '{"a":{"$options":"i"}}', '{"a":{"$regex":"(?=x)"}}', '{"a":{"$regex":"x","$options":"q"}}', '{"a":{"$in":1}}', '{"a":{"$not":5}}', '[1]', "{", '{"$and":1}']


@pytest.mark.parametrize("text", BAD)
def test_errors(text):
    with pytest.raises(bql.BqlError):
        bql.parse(text)


def test_literals():
    assert bql.parse('{"_id":"0123456789abcdef01234567"}') == bql.Leaf("eq", "_id", bql.Literal("objectid", "0123456789abcdef01234567"))
    assert bql.literal(5).kind == "int32" and bql.literal(1 << 40).kind == "int64" and bql.literal(1.5).kind == "double"
    assert bql.literal({"$numberLong": "5"}).kind == "int64"
    assert bql.literal({"$date": "2024-01-01T00:00:00Z"}).kind == "datetime"
    assert bql.parse({"a": {"$regularExpression": {"pattern": "x", "options": "i"}}}).op == "regex"


SCALAR = st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([0.5, 1.0, 2.5, float(2**53)]), st.sampled_from(["a", "b", "ab", "x"]), st.booleans(), st.just(2**53 + 1))
NUMBER = st.one_of(st.integers(-3, 3), st.sampled_from([0.5, 1.0, 2.5]))
PATH = st.sampled_from(["n", "d", "s", "b", "tags", "nums", "items", "items.p", "items.t", "o.x", "o.y", "nums.0", "items.0.p", "zz", "n.q"])


def leaf_body(inner=SCALAR):
    notnull = inner.filter(lambda x: x is not None)
    return st.one_of(
        st.tuples(st.sampled_from(["$eq", "$ne"]), inner).map(lambda t: dict([t])),
        st.tuples(st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), notnull).map(lambda t: dict([t])),
        st.tuples(st.sampled_from(["$in", "$nin", "$all"]), st.lists(inner, max_size=3)).map(lambda t: dict([t])),
        st.integers(0, 3).map(lambda n: {"$size": n}),
        st.sampled_from(["a", "^a", "b$", "."]).map(lambda p: {"$regex": p}),
        st.booleans().map(lambda x: {"$exists": x}),
    )


ELEMENT = st.one_of(leaf_body(), st.dictionaries(st.sampled_from(["p", "t"]), leaf_body(), min_size=1, max_size=2), st.lists(leaf_body(), min_size=1, max_size=2).map(lambda x: {"$or": x}))
CONDITION = st.tuples(PATH, st.one_of(leaf_body(), SCALAR, leaf_body().map(lambda x: {"$not": x}), ELEMENT.map(lambda e: {"$elemMatch": e}))).map(lambda t: dict([t]))
QUERY = st.recursive(CONDITION, lambda q: st.one_of(st.tuples(st.sampled_from(["$and", "$or", "$nor"]), st.lists(q, min_size=1, max_size=3)).map(lambda t: dict([t])), q.map(lambda x: {"$not": x})), max_leaves=5)

DDL = "_id int, n bigint, d double, s string, b boolean, tags array<string>, nums array<int>, items array<struct<p:int,t:string>>, o struct<x:int,y:array<string>>"
ROWS = [
    {"n": 1, "d": 0.5, "s": "a", "b": True, "tags": ["a", "b"], "nums": [1, 2], "items": [{"p": 1, "t": "a"}, {"p": 3, "t": "b"}], "o": {"x": 1, "y": ["a"]}},
    {"n": None, "d": None, "s": None, "b": None, "tags": None, "nums": None, "items": None, "o": None},
    {"n": 2**53 + 1, "d": float(2**53), "s": "ab", "b": False, "tags": [], "nums": [], "items": [], "o": {"x": None, "y": []}},
    {"n": -2, "d": 2.5, "s": "x", "b": True, "tags": ["x"], "nums": [-1, 3, 3], "items": [{"p": None, "t": "x"}, {"p": 2, "t": None}], "o": {"x": 2, "y": ["b", "ab"]}},
]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([{"_id": i, **r} for i, r in enumerate(ROWS)], DDL).cache()


def stripped(x):
    """Null fields left out: typed columns cannot tell them from missing ones."""
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if v is not None}
    return [stripped(v) for v in x] if isinstance(x, list) else x


@settings(max_examples=120, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(QUERY, min_size=8, max_size=8))
def test_compiled_equals_evaluator(typed, queries):
    trees = [bql.parse(q) for q in queries]
    compiler = Compiler(typed.schema)
    kinds = {"n", "d", "s", "b"}
    columns = [compiler.value(t).alias(f"v{i}") for i, t in enumerate(trees)] + [F.coalesce(compiler.condition(normalize(t, kinds.__contains__)), F.lit(False)).alias(f"c{i}") for i, t in enumerate(trees)]
    for row in typed.select("_id", *columns).collect():
        document = stripped(ROWS[row["_id"]])
        for i, t in enumerate(trees):
            want = evaluator.test(t, document)
            assert row[f"v{i}"] is want, (queries[i], document)
            assert row[f"c{i}"] is want, (queries[i], document)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(QUERY, min_size=4, max_size=4))
def test_dynamic_equals_evaluator(spark, queries):
    documents = [*map(stripped, ROWS), {"n": None, "s": 5, "nums": "a", "items": [1, {"p": [1, 2]}, [{"p": 3}]], "tags": [None, "a", 1], "o": {"x": "a"}}]
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "_id int, j string").select("_id", F.parse_json("j").alias("_doc"))
    trees = [bql.parse(q) for q in queries]
    compiler = DynamicCompiler()
    for row in table.select("_id", *[compiler.value(t).alias(f"v{i}") for i, t in enumerate(trees)]).collect():
        for i, t in enumerate(trees):
            assert row[f"v{i}"] is evaluator.test(t, documents[row["_id"]]), (queries[i], documents[row["_id"]])


@settings(max_examples=300, deadline=None)
@given(QUERY)
def test_json_round_trip(query):
    tree = bql.parse(query)
    again = bql.parse(bql.to_json(tree))
    for r in ROWS:
        assert evaluator.test(tree, stripped(r)) == evaluator.test(again, stripped(r))


def test_pushdown(typed, tmp_path, spark):
    path = f"{tmp_path}/t"
    typed.write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(Compiler(df.schema).condition(bql.parse('{"n":{"$gte":1.5,"$lt":9},"s":"a"}')))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,1)" in plan and "LessThan(n,9)" in plan and "EqualTo(s,a)" in plan


def test_big_integers(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "n bigint")
    find = lambda q: sorted(r.n for r in df.where(Compiler(df.schema).condition(bql.parse(q))).collect())
    assert find({"n": {"$eq": 9007199254740992.0}}) == [9007199254740992]
    assert find({"n": {"$gt": 9007199254740992.0}}) == [9007199254740993]


def test_contradictions_hold_for_scalars_alone():
    both = bql.parse('{"a":{"$gt":10,"$lt":5}}')
    assert normalize(both, lambda p: True) == bql.Const(False) and isinstance(normalize(both), bql.And)
    assert normalize(bql.parse('{"$and":[{"a":5},{"a":{"$numberLong":"5"}}]}'), lambda p: True) != bql.Const(False)
    assert normalize(bql.parse('{"a":{"$in":[]}}')) == bql.Const(False)

"""Access paths: which index serves a query, and what it leaves to test."""

import pytest

from bramble.operators.index import parse_indexes
from bramble.plans.access import Histogram, access_path, shape
from bramble.plans.bql import Const, Leaf, parse
from bramble.plans.normalize import normalize

SPEC = {
    "age": {"bson_type": "int32"}, "city": {"bson_type": "string"}, "tags": {"bson_type": "string", "multi_key": True},
    "$compound": {"name": "city_age", "fields": [{"selector": "city", "bson_type": "string"}, {"selector": "age", "bson_type": "int32"}]},
}
INDEXES = {i.name: i.ready() for i in parse_indexes(SPEC)}


def path(query, sort=None, histograms=None):
    return access_path(normalize(parse(query), lambda p: p != "tags"), INDEXES, "_id", sort, histograms)


@pytest.mark.parametrize(
    "query, node, index",
    [
        ({}, "FULL_SCAN", None), ({"age": 5}, "INDEX_SCAN", "age"), ({"age": {"$gt": 5, "$lt": 9}}, "RANGE_SCAN", "age"), ({"city": "a", "age": {"$gt": 5}}, "COMPOUND_SCAN", "city_age"),
        ({"_id": "x", "age": 5}, "INDEX_SCAN", "primary"), ({"age": "text"}, "FULL_SCAN", None), ({"$not": {"age": 5}}, "FULL_SCAN", None), ({"zip": 1}, "FULL_SCAN", None),
        ({"$or": [{"age": 1}, {"city": "a"}]}, "UNION", None), ({"$or": [{"age": 1}, {"zip": 2}]}, "FULL_SCAN", None), ({"age": {"$in": [1, 2]}}, "UNION", None),
        ({"age": {"$gt": 9, "$lt": 5}}, "EMPTY", None), ({"tags": {"$ne": "a"}}, "FULL_SCAN", None), ({"city": {"$regex": "^a"}}, "FULL_SCAN", None),
    ],
)
def test_choice(query, node, index):
    found = path(query)
    assert (found.node, found.index) == (node, index)


def test_residual_and_sort():
    found = path({"city": "a", "zip": 3})
    assert found.bounds == (Leaf("eq", "city", parse({"city": "a"}).value),) and found.residual == parse({"zip": 3})
    assert path({"city": "a", "age": 3}).residual == Const(True)
    assert path({"age": {"$in": [2, 1]}}, "age").node == "ORDERED_CONCAT" and path({}, "age").index == "age"


def test_estimates():
    flat = Histogram(tuple((i * 10, i * 10 + 9, 10) for i in range(10)), 1000)
    assert 0.1 <= flat.fraction("lt", 20) <= 0.3 and 0.7 <= flat.fraction("gte", 20) <= 0.9
    assert path({"age": {"$lt": 20}}, histograms={"age": flat}).rows == pytest.approx(250, abs=50)


def test_shape():
    assert shape(parse({"a": 1, "b": "x"})) == shape(parse({"b": "y", "a": 2})) != shape(parse({"a": 1, "b": 2}))

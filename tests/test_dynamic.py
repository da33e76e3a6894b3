"""Schemaless buckets, and their projections and updates against the typed ones."""

import json

import pytest
from pyspark.sql import functions as F

from bramble.operators.bucket import Catalog
from bramble.operators.dynamic import change_document, project_document
from bramble.operators.project import Projection, project
from bramble.operators.update import Update, update
from bramble.plans.bql import parse

DDL = "_id int, a int, o struct<x:int,y:array<int>>, items array<struct<p:int,t:string>>, nums array<int>"
ROWS = [
    {"_id": 1, "a": 1, "o": {"x": 1, "y": [1, 2, 3]}, "items": [{"p": 1, "t": "a"}, {"p": 5, "t": "b"}, {"p": 7, "t": "a"}], "nums": [4, 5, 6]},
    {"_id": 2, "a": 2, "o": {"x": 2, "y": []}, "items": [], "nums": []},
]
SPECS = [{"a": 1, "o.x": 1}, {"a": 0, "items.t": 0}, {"items.p": 1, "_id": 0}, {"items.$": 1}, {"nums": {"$slice": -2}}, {"nums": {"$slice": [1, 1]}, "a": 1}, {"nums.$": 1}, {"_id": 1}]
UPDATES = [
    {"$set": {"a": 9, "items.$[].t": "z"}}, {"$unset": ["items.1"]}, {"$set": {"items.$.t": "q"}}, {"$unset": ["items.$[]"]}, {"$set": {"nums.$[n]": 0}, "array_filters": [{"n": {"$gte": 5}}]},
    {"$unset": ["items.$[i]"], "array_filters": [{"i.p": {"$lt": 6}}]}, {"$set": {"o.x": 7, "nums.1": 8, "nums.9": 8}}, {"$unset": {"nums.$[n]": ""}, "array_filters": [{"n": {"$eq": 4}}]},
]
QUERY = {"items.p": {"$gte": 5}, "nums": 6}


def clean(x):
    if isinstance(x, dict):
        return {k: clean(v) for k, v in x.items() if v is not None}
    return [clean(v) for v in x] if isinstance(x, list) else x


@pytest.mark.parametrize("spec", SPECS)
def test_projections_agree(spark, spec):
    table = spark.createDataFrame(ROWS, DDL)
    typed = [clean(r.asDict(recursive=True)) for r in project(table, spec, parse(QUERY)).collect()]
    what = Projection.of(spec)
    for row, want in zip(ROWS, typed, strict=True):
        got = project_document({k: v for k, v in row.items() if k != "_id"}, what, parse(QUERY))
        assert ({"_id": row["_id"]} if what.keep_id else {}) | got == want


@pytest.mark.parametrize("spec", UPDATES)
def test_updates_agree(spark, spec):
    table = spark.createDataFrame(ROWS, DDL)
    typed = {r._id: clean(r.asDict(recursive=True)) for r in update(table, QUERY, spec).table.collect()}
    got = change_document(ROWS[0], Update.of(spec), parse(QUERY))
    assert clean(got) == typed[1] and clean(ROWS[1]) == typed[2]


def test_bucket(spark):
    session = Catalog(spark).session()
    session.create("d", dynamic=True)
    session.insert("d", [{"_id": "1", "v": 5, "t": ["x"]}, {"_id": "2", "v": "five"}, {"_id": "3", "v": None}, {"_id": "4", "w": {"z": [1, {"q": 2}]}}, {"_id": "5", "v": 2.5}])
    ids = lambda df: [r._id for r in df.collect()]
    assert ids(session.query("d", {"v": {"$gt": 2}})) == ["1", "5"]
    assert ids(session.query("d", {"v": None})) == ["3", "4"] and ids(session.query("d", {"v": {"$exists": True}})) == ["1", "2", "3", "5"]
    assert ids(session.query("d", {}, sort_by=("v", "ASC"))) == ["3", "4", "5", "1", "2"]
    assert ids(session.query("d", {"w.z.q": 2})) == ["4"]
    show = lambda i: json.loads(session.query("d", {}).where(f"_id = '{i}'").select(F.to_json("_doc")).first()[0])
    assert ids(session.update("d", {"v": {"$in": [5, "five"]}}, {"$set": {"v": {"deep": [1]}, "n.m": 1}})) == ["1", "2"]
    assert show("1") == {"v": {"deep": [1]}, "t": ["x"], "n": {"m": 1}} and show("3") == {"v": None}
    session.update("d", {"k": 1, "v": {"$gt": 100}}, {"$set": {"s": "new"}, "upsert": True}, new_id="6")
    assert show("6") == {"k": 1, "s": "new"}
    assert session.query("d", {}, projection={"v": 1}).count() == 6
    session.delete("d", {"v.deep": 1})
    assert ids(session.query("d", {})) == ["3", "4", "5", "6"]

"""BSON: published examples byte by byte, round trips, and sessions that speak it."""

import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.operators.bucket import Catalog
from bramble.plans.bql import BqlError
from bramble.sources import bson

HELLO = b"\x16\x00\x00\x00\x02hello\x00\x06\x00\x00\x00world\x00\x00"
AWESOME = b"1\x00\x00\x00\x04BSON\x00&\x00\x00\x00\x020\x00\x08\x00\x00\x00awesome\x00\x011\x00333333\x14@\x102\x00\xc2\x07\x00\x00\x00\x00"
SCALARS = st.one_of(
    st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(max_size=8), st.decimals(allow_nan=False, allow_infinity=False, places=3, min_value=-(10**9), max_value=10**9),
    st.binary(min_size=12, max_size=12).map(lambda b: {"$oid": b.hex()}), st.just({"$date": "2024-02-29T12:30:00.250Z"}), st.just({"$timestamp": {"t": 7, "i": 9}}), st.just({"$binary": {"base64": "aGVsbG8=", "subType": "00"}}),
    st.just({"$regularExpression": {"pattern": "^a", "options": "i"}}),
)
NAMES = st.text(st.characters(exclude_characters="\0$", exclude_categories=["Cs"]), min_size=1, max_size=6)
DOCUMENTS = st.dictionaries(NAMES, st.recursive(SCALARS, lambda x: st.lists(x, max_size=3) | st.dictionaries(NAMES, x, min_size=1, max_size=3), max_leaves=8), max_size=5)


def test_published_examples():
    assert bson.encode({"hello": "world"}) == HELLO and bson.decode(HELLO) == {"hello": "world"}
    assert bson.encode({"BSON": ["awesome", 5.05, 1986]}) == AWESOME and bson.decode(AWESOME) == {"BSON": ["awesome", 5.05, 1986]}
    for wrong in (b"", HELLO[:-1], HELLO + b"\0", b"\x0c\0\0\0\x7fa\0\0\0\0\0\0"):
        with pytest.raises(BqlError):
            bson.decode(wrong)


@settings(max_examples=200, deadline=None)
@given(DOCUMENTS)
def test_round_trip(document):
    assert bson.decode(bson.encode(document)) == document


def test_json_of_values():
    assert bson.as_json({"a": Decimal("1.50"), "b": [math.inf, None, True], "c": {"$oid": "ab"}}) == '{"a":1.50,"b":[{"$numberDouble":"Infinity"},null,true],"c":{"$oid":"ab"}}'


def test_sessions(spark):
    session = Catalog(spark).session()
    session.create("b", dynamic=True)
    session.set_attribute("input_type", "bson")
    session.insert("b", [bson.encode({"_id": "1", "at": {"$date": "2024-01-01T00:00:00Z"}, "n": 5}), bson.encode({"_id": "2", "at": {"$date": "2025-01-01T00:00:00Z"}, "n": 2**40})])
    session.set_attribute("reply_type", "bson")
    found = session.query("b", {"at": {"$gt": {"$date": "2024-06-01T00:00:00Z"}}}).collect()
    assert len(found) == 1 and bson.decode(found[0].bson)["_doc"]["n"] == 2**40
    rows = spark.createDataFrame([(1, bytearray(HELLO)), (2, None)], "k int, d binary")
    assert [(r.k, r.v) for r in bson.from_bson(rows, "d").selectExpr("k", "try_variant_get(_doc, '$.hello', 'string') AS v").collect()] == [(1, "world"), (2, None)]

"""BSON in and out: documents as bytes, read into one VARIANT column and written from JSON.

What JSON has no type for is extended JSON in the VARIANT ({"$oid"}, {"$date"},
{"$binary"}, {"$timestamp"}, {"$regularExpression"}), which the schemaless
predicates and orders read.  A decimal is a number where it has at most 38
digits, else {"$numberDecimal"}.  Spark has no reader for BSON, so bytes are
decoded in Python, in Arrow batches.

Defined results: a null stays null; bytes that are no document raise.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Iterator, Mapping, Sequence
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.operators.zmap import decode_d128, encode_d128
from bramble.plans.bql import BqlError
from bramble.sources.documents import DOCUMENT

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _name(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode(), end + 1


def _take(data: bytes, at: int, n: int) -> bytes:
    if n < 0 or at + n > len(data):
        raise BqlError("a BSON value ends too early")
    return data[at : at + n]


def _value(kind: int, data: bytes, at: int) -> tuple[Any, int]:
    """(the value at a place, the place after it)."""
    match kind:
        case 0x01:
            return struct.unpack("<d", _take(data, at, 8))[0], at + 8
        case 0x02:
            n = struct.unpack("<i", _take(data, at, 4))[0]
            return _take(data, at + 4, n)[:-1].decode(), at + 4 + n
        case 0x03 | 0x04:
            n = struct.unpack("<i", _take(data, at, 4))[0]
            body = _fields(_take(data, at, n))
            return (body if kind == 0x03 else [v for _, v in body.items()]), at + n
        case 0x05:
            n, subtype = struct.unpack("<iB", _take(data, at, 5))
            return {"$binary": {"base64": base64.b64encode(_take(data, at + 5, n)).decode(), "subType": f"{subtype:02x}"}}, at + 5 + n
        case 0x07:
            return {"$oid": _take(data, at, 12).hex()}, at + 12
        case 0x08:
            return _take(data, at, 1) == b"\1", at + 1
        case 0x09:
            moment = _EPOCH + timedelta(milliseconds=struct.unpack("<q", _take(data, at, 8))[0])
            return {"$date": moment.isoformat(timespec="milliseconds").replace("+00:00", "Z")}, at + 8
        case 0x0A:
            return None, at
        case 0x0B:
            pattern, at = _name(data, at)
            options, at = _name(data, at)
            return {"$regularExpression": {"pattern": pattern, "options": options}}, at
        case 0x10:
            return struct.unpack("<i", _take(data, at, 4))[0], at + 4
        case 0x11:
            i, t = struct.unpack("<II", _take(data, at, 8))
            return {"$timestamp": {"t": t, "i": i}}, at + 8
        case 0x12:
            return struct.unpack("<q", _take(data, at, 8))[0], at + 8
        case 0x13:
            return decode_d128(_take(data, at, 16)), at + 16
    raise BqlError(f"BSON type {kind:#x} is not supported")


def _fields(data: bytes) -> dict[str, Any]:
    if len(data) < 5 or struct.unpack("<i", data[:4])[0] != len(data) or data[-1]:
        raise BqlError("no BSON document")
    out, at = {}, 4
    while at < len(data) - 1:
        name, place = _name(data, at + 1)
        out[name], at = _value(data[at], data, place)
    return out


def decode(data: bytes) -> dict[str, Any]:
    """A document's fields; decimals as such, other types without a counterpart as extended JSON."""
    try:
        return _fields(bytes(data))
    except (ValueError, struct.error) as error:
        raise BqlError(f"no BSON document: {error}") from error


def as_json(value: Any) -> str:
    """Decoded values as JSON text, decimals as plain numbers."""
    if isinstance(value, Mapping):
        return "{" + ",".join(f"{json.dumps(k)}:{as_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(as_json, value)) + "]"
    if isinstance(value, Decimal):
        text = format(value, "f")
        return text if sum(c.isdigit() for c in text) <= 38 else as_json({"$numberDecimal": str(value)})
    if isinstance(value, float) and not math.isfinite(value):
        return as_json({"$numberDouble": "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"})
    return json.dumps(value)


def _date(body: Any) -> int:
    if isinstance(body, Mapping):
        return int(body["$numberLong"])
    if isinstance(body, int):
        return body
    when = datetime.fromisoformat(body.replace("Z", "+00:00"))
    return ((when if when.tzinfo else when.replace(tzinfo=UTC)) - _EPOCH) // timedelta(milliseconds=1)


def _encoded(value: Any) -> tuple[int, bytes]:
    """(type, bytes) of a value."""
    if value is None:
        return 0x0A, b""
    if isinstance(value, bool):
        return 0x08, bytes([value])
    if isinstance(value, int):
        if -(1 << 31) <= value < 1 << 31:
            return 0x10, struct.pack("<i", value)
        if -(1 << 63) <= value < 1 << 63:
            return 0x12, struct.pack("<q", value)
        return 0x13, encode_d128(Decimal(value))
    if isinstance(value, float):
        return 0x01, struct.pack("<d", value)
    if isinstance(value, Decimal):
        return 0x13, encode_d128(value)
    if isinstance(value, str):
        text = value.encode() + b"\0"
        return 0x02, struct.pack("<i", len(text)) + text
    if isinstance(value, bytes | bytearray):
        return 0x05, struct.pack("<iB", len(value), 0) + bytes(value)
    if isinstance(value, Sequence):
        return 0x04, encode({str(i): v for i, v in enumerate(value)})
    if len(value) == 1:
        name, body = next(iter(value.items()))
        match name:
            case "$oid":
                return 0x07, bytes.fromhex(body)
            case "$date":
                return 0x09, struct.pack("<q", _date(body))
            case "$binary":
                inner = body if isinstance(body, Mapping) else {"base64": body}
                data = base64.b64decode(inner["base64"])
                return 0x05, struct.pack("<iB", len(data), int(str(inner.get("subType", "0")), 16)) + data
            case "$timestamp":
                return 0x11, struct.pack("<II", body["i"], body["t"])
            case "$regularExpression":
                return 0x0B, body["pattern"].encode() + b"\0" + body.get("options", "").encode() + b"\0"
            case "$numberDecimal":
                return 0x13, encode_d128(Decimal(body))
            case "$numberDouble":
                return 0x01, struct.pack("<d", float(body))
    return 0x03, encode(value)


def encode(document: Mapping[str, Any]) -> bytes:
    """A document of JSON or extended JSON as BSON."""
    parts = []
    for name, value in document.items():
        if "\0" in name:
            raise BqlError("a field's name has no zero byte")
        kind, body = _encoded(value)
        parts += [bytes([kind]), name.encode() + b"\0", body]
    data = b"".join(parts)
    return struct.pack("<i", len(data) + 5) + data + b"\0"


def from_bson(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column of BSON documents as one VARIANT column."""
    others = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if b is None else as_json(decode(b)) for b in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], names=[*others, "__json"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    texts = rows.select(*others, column).mapInArrow(run, f"{kinds + ', ' if kinds else ''}__json string")
    return texts.select(*others, F.parse_json("__json").alias(DOCUMENT))


def to_bson(rows: DataFrame, json_column: str, name: str = "bson") -> DataFrame:
    """Rows of JSON texts as BSON documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else encode(json.loads(t)) for t in batch.column(0).to_pylist()], pa.binary())], names=[name])

    return rows.select(json_column).mapInArrow(run, f"`{name}` binary")

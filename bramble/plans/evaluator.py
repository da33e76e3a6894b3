"""The predicates over Python documents: the meaning that the compiled columns are tested against."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime
from decimal import Decimal
from typing import Any

from bramble.plans.bql import And, Const, Elem, Leaf, Literal, Not, Or

MISSING = object()


def select(document: Any, path: str) -> Any:
    """The value at a path, or MISSING."""
    value = document
    for segment in path.split(".") if path else ():
        if isinstance(value, Mapping):
            value = value.get(segment, MISSING)
        elif isinstance(value, list) and segment.isdigit():
            value = value[int(segment)] if int(segment) < len(value) else MISSING
        elif isinstance(value, list):
            value = _gather(value, segment)
        else:
            return MISSING
        if value is MISSING:
            return MISSING
    return value


def _gather(items: list, name: str) -> Any:
    out: list = []
    for item in items:
        if isinstance(item, list):
            inner = _gather(item, name)
            out += inner if inner is not MISSING else []
        elif isinstance(item, Mapping) and item.get(name, MISSING) is not MISSING and item[name] is not None:
            out += item[name] if isinstance(item[name], list) else [item[name]]
    return out or MISSING


def _bracket(value: Any) -> str:
    for kind, name in ((bool, "boolean"), ((int, float, Decimal), "number"), (str, "string"), (bytes, "binary"), (datetime, "datetime"), (Mapping, "document"), (list, "array")):
        if isinstance(value, kind):
            return name
    return "null"


def _exact(value: Any) -> Any:
    return Decimal(repr(value)) if isinstance(value, float) else Decimal(value)


def _scalar(value: Any, op: str, x: Literal) -> bool:
    other = "number" if x.is_numeric else "binary" if x.kind == "versionstamp" else x.kind
    mine = _bracket(value)
    if mine != other or mine in ("null", "document", "array"):
        return False
    right = x.value
    if mine == "number" and not (isinstance(value, float) and isinstance(right, float)):
        value, right = _exact(value), _exact(right)
    if mine == "boolean" and op not in ("eq", "ne"):
        return False
    if op in ("eq", "ne"):
        return (value == right) == (op == "eq")
    return {"gt": value > right, "gte": value >= right, "lt": value < right, "lte": value <= right}[op]


def _matches(value: Any, x: Literal) -> bool:
    if x.kind == "regex":
        pattern, flags = x.value
        bits = sum({"i": re.I, "m": re.M, "s": re.S, "u": re.U}[f] for f in flags)
        return isinstance(value, str) and re.search(pattern, value, bits) is not None
    return value is None if x.is_null else _scalar(value, "eq", x)


def test(tree: Any, document: Any) -> bool:
    match tree:
        case Const(value):
            return value
        case And(children):
            return all(test(c, document) for c in children)
        case Or(children):
            return any(test(c, document) for c in children)
        case Not(child):
            return not test(child, document)
        case Elem(path, sub):
            if sub == And(()):
                return True
            value = select(document, path)
            return isinstance(value, list) and any(test(sub, e if isinstance(e, Mapping) else {"": e}) for e in value)
        case Leaf(op, path, x):
            value = document.get("", MISSING) if path == "" and isinstance(document, Mapping) else select(document, path)
            return _leaf(op, value, x)
    raise TypeError(tree)


def _leaf(op: str, value: Any, x: Any) -> bool:
    absent = value is MISSING or value is None
    if op == "exists":
        return (value is not MISSING) == x
    if op == "size":
        return isinstance(value, list) and len(value) == x
    if op == "all":
        return isinstance(value, list) and all(any(_matches(e, i) for e in value) for i in x)
    if op in ("in", "nin"):
        if absent:
            found = any(i.is_null for i in x)
        elif isinstance(value, list):
            found = any(_matches(e, i) for e in value for i in x)
        else:
            found = any(_matches(value, i) for i in x if not i.is_null)
        return found == (op == "in")
    if op == "regex":
        return any(_matches(e, x) for e in value) if isinstance(value, list) else not absent and _matches(value, x)
    if x.is_null:
        return absent == (op == "eq")
    if op == "ne":
        if absent:
            return True
        return not any(_scalar(e, "eq", x) for e in value) if isinstance(value, list) else _scalar(value, "ne", x)
    if absent:
        return False
    return any(_scalar(e, op, x) for e in value) if isinstance(value, list) else _scalar(value, op, x)

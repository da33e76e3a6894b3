"""The filter language: literals, expressions, and the parser from JSON or Python values.

A query is a JSON object; nodes of the tree are three connectives, a constant,
an element match and a leaf that applies one operator at one path.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal
from typing import Any


class BqlError(ValueError):
    """A query, projection, update or option that the language does not allow."""


@dataclass(frozen=True)
class Literal:
    """kind: null int32 int64 double decimal string document array binary objectid boolean datetime timestamp versionstamp regex."""

    kind: str
    value: Any = None

    @property
    def is_null(self) -> bool:
        return self.kind == "null"

    @property
    def is_numeric(self) -> bool:
        return self.kind in ("int32", "int64", "double", "decimal")


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Leaf:
    """op: eq ne gt gte lt lte in nin all size exists regex."""

    op: str
    path: str
    value: Any


@dataclass(frozen=True)
class Elem:
    path: str
    sub: Any


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: Any


COMPARISONS = ("gt", "gte", "lt", "lte")
_WRAPPERS = ("$oid", "$date", "$numberInt", "$numberLong", "$numberDouble", "$numberDecimal", "$binary", "$timestamp", "$regularExpression")
_UNSUPPORTED_REGEX = re.compile(r"\(\?(?:=|!|<=|<!)|\\[1-9]")
REGEX_FLAGS = "imsu"


def _integer(n: int) -> Literal:
    if -(1 << 31) <= n < 1 << 31:
        return Literal("int32", n)
    if -(1 << 63) <= n < 1 << 63:
        return Literal("int64", n)
    return Literal("double", float(n))


def _regex(pattern: Any, options: Any) -> Literal:
    if not isinstance(pattern, str) or not isinstance(options, str):
        raise BqlError("a regular expression and its options are strings")
    if unknown := set(options) - set(REGEX_FLAGS):
        raise BqlError(f"unknown regular expression options {sorted(unknown)}")
    if _UNSUPPORTED_REGEX.search(pattern):
        raise BqlError("lookaround and back-references are not supported in regular expressions")
    try:
        re.compile(pattern)
    except re.error as error:
        raise BqlError(f"invalid regular expression: {error}") from error
    return Literal("regex", (pattern, "".join(sorted(set(options)))))


def _date(value: Any) -> Literal:
    if isinstance(value, Mapping) and set(value) == {"$numberLong"}:
        value = int(value["$numberLong"])
    if isinstance(value, int):
        return Literal("datetime", datetime.fromtimestamp(value / 1000, UTC).replace(tzinfo=None))
    try:
        when = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError as error:
        raise BqlError(f"invalid date {value!r}") from error
    return Literal("datetime", when.astimezone(UTC).replace(tzinfo=None) if when.tzinfo else when)


def _wrapped(value: Mapping) -> Literal:
    name, body = next(iter(value.items()))
    try:
        match name:
            case "$oid":
                return Literal("objectid", _object_id(body))
            case "$date":
                return _date(body)
            case "$numberInt":
                return Literal("int32", int(body))
            case "$numberLong":
                return Literal("int64", int(body))
            case "$numberDouble":
                return Literal("double", float(body))
            case "$numberDecimal":
                return Literal("decimal", Decimal(body))
            case "$timestamp":
                return Literal("timestamp", (int(body["t"]) << 32) | int(body["i"]))
            case "$regularExpression":
                return _regex(body["pattern"], body.get("options", ""))
            case _:
                return _binary(base64.b64decode(body["base64"] if isinstance(body, Mapping) else body))
    except (ValueError, KeyError, TypeError, ArithmeticError) as error:
        raise BqlError(f"invalid {name} value: {error}") from error


def _object_id(text: str) -> str:
    if not re.fullmatch("[0-9a-fA-F]{24}", text):
        raise BqlError(f"invalid object id {text!r}")
    return text.lower()


def _binary(data: bytes) -> Literal:
    complete = len(data) == 12 and data[:10] != b"\xff" * 10
    return Literal("versionstamp" if complete else "binary", data)


def literal(value: Any) -> Literal:
    """A Python or JSON value as a literal; 24 hex digits are an object id."""
    if isinstance(value, Literal):
        return value
    if value is None:
        return Literal("null")
    if isinstance(value, bool):
        return Literal("boolean", value)
    if isinstance(value, int):
        return _integer(value)
    if isinstance(value, float):
        return Literal("double", value)
    if isinstance(value, Decimal):
        return Literal("decimal", value)
    if isinstance(value, str):
        if re.fullmatch("[0-9a-fA-F]{24}", value):
            return Literal("objectid", value.lower())
        if re.fullmatch("[0-9A-V]{20}", value) and (data := _base32hex(value)) is not None and data[:10] != b"\xff" * 10:
            return Literal("versionstamp", data)
        return Literal("string", value)
    if isinstance(value, bytes | bytearray):
        return _binary(bytes(value))
    if isinstance(value, datetime):
        return Literal("datetime", value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value)
    if isinstance(value, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if value.flags & bit)
        return _regex(value.pattern, flags)
    if isinstance(value, Mapping):
        if len(value) == 1 and next(iter(value)) in _WRAPPERS:
            return _wrapped(value)
        return Literal("document", tuple((str(k), literal(v)) for k, v in value.items()))
    if isinstance(value, Sequence):
        return Literal("array", tuple(literal(v) for v in value))
    raise BqlError(f"unsupported value {value!r}")


def _base32hex(text: str) -> bytes | None:
    try:
        return base64.b32hexdecode(text + "====")[:12]
    except ValueError:
        return None


def _is_operators(value: Any) -> bool:
    return isinstance(value, Mapping) and not (len(value) == 1 and next(iter(value)) in _WRAPPERS)


def _list(name: str, value: Any) -> Sequence:
    if not isinstance(value, Sequence) or isinstance(value, str | bytes):
        raise BqlError(f"{name} takes an array")
    return value


def _join(children: list) -> Any:
    return children[0] if len(children) == 1 else And(tuple(children))


def _expression(query: Any, element: bool = False) -> Any:
    """An object of fields and connectives; inside an element match also of operators on the element itself."""
    if not isinstance(query, Mapping):
        raise BqlError("an expression is an object")
    children, operators = [], {}
    for name, value in query.items():
        if name in ("$and", "$or", "$nor"):
            parts = tuple(_expression(v, element) for v in _list(name, value))
            children.append(And(parts) if name == "$and" else Or(parts) if name == "$or" else Not(Or(parts)))
        elif name == "$not":
            children.append(Not(_expression(value, element)))
        elif name.startswith("$"):
            if not element:
                raise BqlError(f"unknown operator {name}")
            operators[name] = value
        elif _is_operators(value):
            children += _operators(name, value)
        else:
            children.append(_equal(name, value))
    if operators:
        children += _operators("", operators)
    return _join(children)


def _equal(path: str, value: Any) -> Leaf:
    found = literal(value)
    return Leaf("regex" if found.kind == "regex" else "eq", path, found)


def _operators(path: str, body: Mapping) -> list:
    if not body:
        raise BqlError(f"empty operator document at {path!r}")
    if "$options" in body and "$regex" not in body:
        raise BqlError("$options needs $regex")
    out = []
    for name, value in body.items():
        match name:
            case "$eq" | "$ne":
                found = literal(value)
                if found.kind == "regex":
                    raise BqlError(f"{name} takes no regular expression")
                out.append(Leaf(name[1:], path, found))
            case "$gt" | "$gte" | "$lt" | "$lte":
                found = literal(value)
                if found.is_null or found.kind == "regex":
                    raise BqlError(f"{name} takes neither null nor a regular expression")
                out.append(Leaf(name[1:], path, found))
            case "$in" | "$nin" | "$all":
                out.append(Leaf(name[1:], path, tuple(literal(v) for v in _list(name, value))))
            case "$size":
                found = literal(value)
                if found.kind != "int32":
                    raise BqlError("$size takes a 32-bit integer")
                out.append(Leaf("size", path, found.value))
            case "$exists":
                if not isinstance(value, bool):
                    raise BqlError("$exists takes a boolean")
                out.append(Leaf("exists", path, value))
            case "$regex":
                given = literal(value) if not isinstance(value, str) else None
                pattern, flags = given.value if given is not None and given.kind == "regex" else (value, "")
                out.append(Leaf("regex", path, _regex(pattern, body.get("$options", flags))))
            case "$options":
                pass
            case "$elemMatch":
                out.append(Elem(path, _expression(value, element=True)))
            case "$not":
                if _is_operators(value):
                    out.append(Not(_join(_operators(path, value))))
                elif (found := literal(value)).kind == "regex":
                    out.append(Not(Leaf("regex", path, found)))
                else:
                    raise BqlError("$not takes an operator document or a regular expression")
            case _:
                raise BqlError(f"unknown operator {name}")
    return out


def _unique(pairs: list) -> dict:
    return dict(pairs)


def parse(query: str | bytes | Mapping) -> Any:
    """The tree of a query given as JSON text or as a mapping."""
    if isinstance(query, str | bytes):
        try:
            query = json.loads(query, object_pairs_hook=_unique)
        except ValueError as error:
            raise BqlError(f"invalid JSON: {error}") from error
    return _expression(query)


def plain(value: Literal) -> Any:
    """A literal as the JSON value that parses to it."""
    match value.kind:
        case "objectid":
            return {"$oid": value.value}
        case "int64":
            return {"$numberLong": str(value.value)}
        case "decimal":
            return {"$numberDecimal": str(value.value)}
        case "datetime":
            return {"$date": value.value.isoformat(timespec="microseconds") + "Z"}
        case "timestamp":
            return {"$timestamp": {"t": value.value >> 32, "i": value.value & 0xFFFFFFFF}}
        case "binary" | "versionstamp":
            return {"$binary": {"base64": base64.b64encode(value.value).decode(), "subType": "00"}}
        case "regex":
            return {"$regularExpression": {"pattern": value.value[0], "options": value.value[1]}}
        case "document":
            return {k: plain(v) for k, v in value.value}
        case "array":
            return [plain(v) for v in value.value]
        case _:
            return value.value


def to_json(tree: Any) -> dict:
    """A query that parses to an equivalent tree."""
    match tree:
        case Const(value):
            return {} if value else {"$or": []}
        case And(children):
            return {"$and": [to_json(c) for c in children]} if children else {}
        case Or(children):
            return {"$or": [to_json(c) for c in children]}
        case Not(child):
            return {"$not": to_json(child)}
        case Elem(path, sub):
            return {path: {"$elemMatch": to_json(sub)}}
        case Leaf(op, path, value):
            if op in ("in", "nin", "all"):
                body: Any = [plain(v) for v in value]
            elif op in ("size", "exists"):
                body = value
            elif op == "regex":
                body = {"$regex": value.value[0], "$options": value.value[1]}
                return {path: body} if path else body
            else:
                body = plain(value)
            return {path: {f"${op}": body}} if path else {f"${op}": body}
    raise TypeError(tree)


def paths(tree: Any) -> set[str]:
    """The paths that a tree reads, element matches included."""
    match tree:
        case And(children) | Or(children):
            return set().union(*map(paths, children)) if children else set()
        case Not(child):
            return paths(child)
        case Elem(path, _) | Leaf(_, path, _):
            return {path}
    return set()

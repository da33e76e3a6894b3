"""The predicates over one VARIANT column: documents of any shape, missing and null kept apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions import numeric
from bramble.functions.paths import Value
from bramble.plans.bql import COMPARISONS, And, Leaf, Literal
from bramble.plans.compiler import Compiler, _closed, java_pattern

_DECIMAL = T.DecimalType(38, 18)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", "variant")


def _is_array(v: Column) -> Column:
    return kind_of(v).startswith("ARRAY")


def _elements(v: Column) -> Column:
    """The elements of an array value; null for others."""
    return F.when(_is_array(v), v.cast("array<variant>"))


def _step(v: Column, segment: str) -> Column:
    if segment.isdigit():
        return F.coalesce(F.try_variant_get(v, f"$[{segment}]", "variant"), _field(v, segment))
    found = F.filter(F.transform(_elements(v), lambda e: _field(e, segment)), lambda x: x.isNotNull() & (kind_of(x) != "VOID"))
    flat = F.flatten(F.transform(found, lambda x: F.coalesce(_elements(x), F.array(x))))
    return F.coalesce(F.when(F.size(flat) > 0, F.to_variant_object(flat)), _field(v, segment))


def select(root: Column, path: str) -> Column:
    """The value at a dotted path; SQL null where it is missing, a VARIANT null where it is null."""
    return reduce(_step, path.split("."), root) if path else root


@dataclass(frozen=True)
class Document:
    column: Column

    def at(self, path: str) -> Value:
        return Value(select(self.column, path), T.VariantType())


@dataclass(frozen=True)
class _Item:
    """An element: a document by field, anything else by the empty path."""

    column: Column

    def at(self, path: str) -> Value:
        is_document = kind_of(self.column).startswith("OBJECT")
        if path == "":
            return Value(F.when(~is_document, self.column), T.VariantType())
        return Value(F.when(is_document, select(self.column, path)), T.VariantType())


class DynamicCompiler(Compiler):
    """Compiles trees against a VARIANT column."""

    def __init__(self, column: str = "_doc") -> None:
        self.root = Document(F.col(column))
        self.collation = None

    def _element(self, value: Value, sub: Any) -> Column:
        if sub == And(()):
            return F.lit(True)
        return F.exists(_elements(value.column), lambda e: self.value(sub, _Item(e)))

    def _leaf(self, leaf: Leaf, value: Value) -> Column:
        op, x, v = leaf.op, leaf.value, value.column
        absent = v.isNull() | _closed(kind_of(v) == "VOID")
        each = _elements(v)
        any_of = lambda test: _closed(F.exists(each, lambda e: _closed(test(e))))
        over = lambda test: F.when(_closed(_is_array(v)), any_of(test)).otherwise(_closed(test(v)))
        if op == "exists":
            return v.isNotNull() if x else v.isNull()
        if op == "size":
            return F.array_size(each) == x
        if op == "all":
            return reduce(lambda a, b: a & b, [any_of(lambda e, i=i: _matches(e, i)) for i in x], each.isNotNull())
        if op in ("in", "nin"):
            has_null = any(i.is_null for i in x)
            tests = [over(lambda e, i=i: _matches(e, i)) for i in x]
            found = F.when(absent, F.lit(has_null)).otherwise(reduce(lambda a, b: a | b, tests, F.lit(False)))
            return found if op == "in" else ~found
        if op == "regex":
            return over(lambda e: _matches(e, x))
        if x.is_null:
            return absent if op == "eq" else ~absent
        if op == "ne":
            none_equal = ~any_of(lambda e: _scalar(e, "eq", x))
            return absent | F.when(_closed(_is_array(v)), none_equal).otherwise(_closed(_scalar(v, "ne", x)))
        return F.when(absent, F.lit(False)).otherwise(over(lambda e: _scalar(e, op, x)))


def _matches(e: Column, item: Literal) -> Column:
    if item.kind == "regex":
        return F.when(kind_of(e) == "STRING", F.try_variant_get(e, "$", "string").rlike(java_pattern(*item.value))).otherwise(False)
    if item.is_null:
        return kind_of(e) == "VOID"
    return _scalar(e, "eq", item)


#: Extended JSON: the wrapper of a kind of value and the type that its body is read as.
_WRAPPERS = {"objectid": ("$oid", "string"), "datetime": ("$date", "string"), "binary": ("$binary", "string"), "timestamp": ("$timestamp", "variant")}
_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def _wrapped(e: Column, kind: str) -> Column:
    name, target = _WRAPPERS[kind]
    return F.when(kind_of(e).startswith("OBJECT"), F.try_variant_get(e, f"$['{name}']", target))


def datetime_of(e: Column) -> Column:
    """The moment of a date or timestamp value, or of {"$date": text or milliseconds}, as TIMESTAMP_NTZ in UTC; else null."""
    kind = kind_of(e)
    in_utc = lambda t: F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))
    text = _wrapped(e, "datetime")
    millis = F.coalesce(F.try_variant_get(e, "$['$date']", "bigint"), F.try_variant_get(e, "$['$date']['$numberLong']", "bigint"))
    zoned = F.when(text.rlike(_ZONED), in_utc(F.try_to_timestamp(text))).otherwise(text.try_cast("timestamp_ntz"))
    body = F.when(text.rlike(r"^\d{4}-"), zoned).otherwise(in_utc(F.timestamp_millis(millis)))
    return (
        F.when(kind == "TIMESTAMP_NTZ", F.try_variant_get(e, "$", "timestamp_ntz")).when(kind == "TIMESTAMP", in_utc(F.try_variant_get(e, "$", "timestamp")))
        .when(kind == "DATE", F.try_variant_get(e, "$", "date").cast("timestamp_ntz")).when(kind.startswith("OBJECT"), body)
    )


def binary_of(e: Column) -> Column:
    """The bytes of a binary value, or of {"$binary": base64}; else null."""
    text = F.coalesce(F.try_variant_get(e, "$['$binary']['base64']", "string"), _wrapped(e, "binary"))
    return F.when(kind_of(e) == "BINARY", F.try_variant_get(e, "$", "binary")).when(kind_of(e).startswith("OBJECT"), F.try_to_binary(text, F.lit("base64")))


def object_id_of(e: Column) -> Column:
    """The hex digits of {"$oid": text}; else null."""
    return F.lower(_wrapped(e, "objectid"))


def timestamp_of(e: Column) -> Column:
    """The number of {"$timestamp": {"t": seconds, "i": ordinal}}; else null."""
    part = lambda n: F.try_variant_get(e, f"$['$timestamp']['{n}']", "bigint")
    return F.when(kind_of(e).startswith("OBJECT"), F.shiftleft(part("t"), 32).bitwiseOR(part("i")))


def _scalar(e: Column, op: str, x: Literal) -> Column:
    """A scalar against a literal, by the value's own type; other types never match."""
    kind = kind_of(e)
    if x.is_numeric:
        exact, wide = F.try_variant_get(e, "$", "decimal(38,18)"), F.try_variant_get(e, "$", "double")
        decimal = F.when(exact.isNotNull(), numeric.compare(exact, _DECIMAL, op, x)).otherwise(numeric.compare(wide, T.DoubleType(), op, x))
        return (
            F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), numeric.compare(F.try_variant_get(e, "$", "bigint"), T.LongType(), op, x))
            .when(kind.startswith("DECIMAL"), decimal)
            .when(kind.isin("DOUBLE", "FLOAT"), numeric.compare(F.try_variant_get(e, "$", "double"), T.DoubleType(), op, x))
            .otherwise(False)
        )
    if x.kind == "string":
        return F.when(kind == "STRING", numeric.apply(op, F.try_variant_get(e, "$", "string"), F.lit(x.value))).otherwise(False)
    if x.kind == "boolean" and op not in COMPARISONS:
        return F.when(kind == "BOOLEAN", numeric.apply(op, F.try_variant_get(e, "$", "boolean"), F.lit(x.value))).otherwise(False)
    if x.kind == "datetime":
        return F.coalesce(numeric.apply(op, datetime_of(e), F.lit(x.value.isoformat(sep=" ")).cast("timestamp_ntz")), F.lit(False))
    if x.kind == "objectid":
        return F.coalesce(numeric.apply(op, object_id_of(e), F.lit(x.value)), F.lit(False))
    if x.kind == "timestamp":
        return F.coalesce(numeric.apply(op, timestamp_of(e), F.lit(x.value)), F.lit(False))
    if x.kind in ("binary", "versionstamp"):
        return F.coalesce(numeric.apply(op, binary_of(e), F.lit(bytes(x.value))), F.lit(False))
    return F.lit(False)

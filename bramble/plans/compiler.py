"""Query trees as Spark columns over a typed schema.

Predicates have two values: a missing field makes a comparison false, and its
negation true.  Where a condition stands un-negated, null and false filter alike
and the leaf is left bare, so that scans are given it; below a negation, and
where the value itself is used, every leaf is closed with coalesce.

In typed mode null and missing are one: ``$exists`` asks for a value.  Types that
cannot match are settled here, by bracket, and fold to constants.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions import numeric
from bramble.functions.collation import Collation
from bramble.functions.paths import Element, Row, Value
from bramble.plans.bql import COMPARISONS, And, Const, Elem, Leaf, Literal, Not, Or


def _closed(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def bracket(kind: T.DataType | None, bson: str | None = None) -> str | None:
    """The type bracket of a column."""
    if bson in ("objectid", "timestamp"):
        return bson
    match kind:
        case T.NumericType():
            return "number"
        case T.StringType() | T.VarcharType() | T.CharType():
            return "string"
        case T.BooleanType():
            return "boolean"
        case T.BinaryType():
            return "binary"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "datetime"
        case T.StructType() | T.MapType():
            return "document"
        case T.ArrayType():
            return "array"
    return None


def literal_bracket(value: Literal) -> str:
    if value.is_numeric:
        return "number"
    return "binary" if value.kind == "versionstamp" else value.kind


class Compiler:
    """Compiles trees against the schema of one DataFrame."""

    def __init__(self, schema: T.StructType, collation: Collation | None = None) -> None:
        self.root = Row(schema)
        self.collation = collation

    def condition(self, tree: Any) -> Column:
        """For a filter: null counts as false."""
        return self._compile(tree, self.root, open_=True)

    def value(self, tree: Any, root: Any = None) -> Column:
        """True or false, never null."""
        return self._compile(tree, root or self.root, open_=False)

    def _compile(self, tree: Any, root: Any, open_: bool) -> Column:
        match tree:
            case Const(value):
                return F.lit(value)
            case And(children):
                return reduce(lambda a, b: a & b, [self._compile(c, root, open_) for c in children], F.lit(True)) if len(children) != 1 else self._compile(children[0], root, open_)
            case Or(children):
                return reduce(lambda a, b: a | b, [self._compile(c, root, open_) for c in children]) if children else F.lit(False)
            case Not(child):
                return ~self._compile(child, root, open_=False)
            case Elem(path, sub):
                column = self._element(root.at(path), sub)
                return column if open_ else _closed(column)
            case Leaf():
                column = self._leaf(tree, root.at(tree.path))
                return column if open_ else _closed(column)
        raise TypeError(tree)

    def _element(self, value: Value, sub: Any) -> Column:
        if sub == And(()):  # an empty element match asks for nothing
            return F.lit(True)
        if not value.is_array:
            return F.lit(False)
        inner = value.kind.elementType
        return F.exists(value.column, lambda x: self.value(sub, Element(Value(x, inner, value.bson))))

    def _leaf(self, leaf: Leaf, v: Value) -> Column:
        op, x = leaf.op, leaf.value
        if op == "exists":
            present = v.kind is not None
            return (v.column.isNotNull() if x else v.column.isNull()) if present else F.lit(not x)
        if op == "size":
            return F.array_size(v.column) == x if v.is_array else F.lit(False)
        if op == "all":
            if not v.is_array:
                return F.lit(False)
            return reduce(lambda a, b: a & b, [self._any(v, lambda e, item=item: self._matches(e, item)) for item in x], v.column.isNotNull())
        if op in ("in", "nin"):
            found = self._in(v, x)
            return found if op == "in" else ~_closed(found)
        if op == "regex":
            return self._any(v, lambda e: self._matches(e, x)) if v.is_array else self._matches(v, x)
        if x.is_null:
            empty = F.lit(True) if v.kind is None else v.column.isNull()
            return empty if op == "eq" else ~empty
        if op == "ne":
            if v.kind is None:
                return F.lit(True)
            if v.is_array:
                return v.column.isNull() | ~_closed(self._any(v, lambda e: self._compare(e, "eq", x)))
            return v.column.isNull() | _closed(self._compare(v, "ne", x))
        return self._any(v, lambda e: self._compare(e, op, x)) if v.is_array else self._compare(v, op, x)

    def _any(self, v: Value, test) -> Column:
        inner = v.kind.elementType
        return F.exists(v.column, lambda e: _closed(test(Value(e, inner, v.bson))))

    def _in(self, v: Value, items: tuple) -> Column:
        has_null = any(i.is_null for i in items)
        if v.kind is None:
            return F.lit(has_null)
        tests = [i for i in items if not i.is_null]
        if v.is_array:
            alternatives = [v.column.isNull()] if has_null else []
            if has_null:
                alternatives.append(F.exists(v.column, lambda e: e.isNull()))
            if tests:
                alternatives.append(self._any(v, lambda e: reduce(lambda a, b: a | b, [_closed(self._matches(e, i)) for i in tests])))
        else:
            alternatives = [v.column.isNull()] if has_null else []
            same = [i for i in tests if i.kind != "regex" and literal_bracket(i) == bracket(v.kind, v.bson) and self._listable(v, i)]
            if len(same) > 1:
                alternatives.append(v.column.isin([self._plain(v, i) for i in same]))
                tests = [i for i in tests if i not in same]
            alternatives += [self._matches(v, i) for i in tests]
        return reduce(lambda a, b: a | b, alternatives) if alternatives else F.lit(False)

    def _listable(self, v: Value, item: Literal) -> bool:
        """Whether equality with the item is equality with one value of the column's own type."""
        if self.collation is not None:
            return False
        if isinstance(v.kind, T.StringType):
            return True
        if isinstance(v.kind, T.IntegerType | T.LongType) and item.kind in ("int32", "int64"):
            bits = 31 if isinstance(v.kind, T.IntegerType) else 63
            return -(1 << bits) <= item.value < 1 << bits
        return isinstance(v.kind, T.DoubleType) and item.kind in ("double", "int32")

    def _plain(self, v: Value, item: Literal) -> Any:
        return float(item.value) if isinstance(v.kind, T.DoubleType) else item.value

    def _matches(self, v: Value, item: Literal) -> Column:
        if item.kind == "regex":
            if bracket(v.kind, v.bson) != "string":
                return F.lit(False)
            pattern, flags = item.value
            return F.collate(v.column, "UTF8_BINARY").rlike(java_pattern(pattern, flags))
        if item.is_null:
            return v.column.isNull()
        return self._compare(v, "eq", item)

    def _compare(self, v: Value, op: str, x: Literal) -> Column:
        """A scalar against a literal of any type; null where the value is null."""
        mine, other = bracket(v.kind, v.bson), literal_bracket(x)
        if mine != other or mine in (None, "document", "array"):
            return F.lit(False)
        if mine == "number":
            return numeric.compare(v.column, v.kind, op, x)
        if mine == "boolean" and op in COMPARISONS:
            return F.lit(False)
        if mine == "string" and self.collation is not None:
            return self.collation.compare(v.column, op, x.value)
        if mine == "datetime":
            right = F.lit(x.value).cast("timestamp_ntz")
            if isinstance(v.kind, T.TimestampType):
                right = F.lit(x.value.isoformat(sep=" ") + "+00:00").cast("timestamp")
            return numeric.apply(op, v.column, right)
        return numeric.apply(op, v.column, F.lit(x.value))


def java_pattern(pattern: str, flags: str) -> str:
    """The pattern for Java's engine, with its flags inside."""
    pattern = pattern.replace("(?P<", "(?<")
    inline = "".join("u" if f == "u" else f for f in flags)
    return f"(?{inline}){pattern}" if inline else pattern

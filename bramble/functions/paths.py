"""Dotted paths over typed columns.

A numeric segment indexes an array from zero; a name on an array collects the
field of every document element, flattened, and is missing if nothing is there.
A path that leads nowhere is missing (null), never an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    """What a path gives: a column of a known type, or kind None where the path leads nowhere."""

    column: Column
    kind: T.DataType | None
    bson: str | None = None

    @property
    def is_array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)




def missing() -> Value:
    return Value(F.lit(None), None)


def field_of(kind: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in kind.fields if f.name == name), None)


def _step(value: Value, segment: str) -> Value:
    if isinstance(value.kind, T.StructType):
        found = field_of(value.kind, segment)
        return Value(value.column.getField(segment), found.dataType, found.metadata.get("bson")) if found else missing()
    if isinstance(value.kind, T.ArrayType):
        inner = value.kind.elementType
        if segment.isdigit():
            return Value(F.get(value.column, F.lit(int(segment))), inner)
        if not isinstance(inner, T.StructType) or (found := field_of(inner, segment)) is None:
            if isinstance(inner, T.ArrayType):
                return _step(Value(F.flatten(F.filter(value.column, lambda x: x.isNotNull())), inner), segment)
            return missing()
        gathered = F.filter(F.transform(value.column, lambda x: x.getField(segment)), lambda x: x.isNotNull())
        kind: T.DataType = T.ArrayType(found.dataType)
        if isinstance(found.dataType, T.ArrayType):
            gathered, kind = F.flatten(gathered), found.dataType
        return Value(F.when(F.size(gathered) > 0, gathered), kind, found.metadata.get("bson"))
    return missing()


def resolve(path: str, root: Value) -> Value:
    """The value at a path below root; the empty path is root itself."""
    value = root
    for segment in path.split(".") if path else ():
        value = _step(value, segment)
        if value.kind is None:
            break
    return value


@dataclass(frozen=True)
class Row:
    """The top level of a DataFrame as a root for paths: plain columns, so that scans can be given conditions on them."""

    schema: T.StructType

    def at(self, path: str) -> Value:
        name, _, rest = path.partition(".")
        found = field_of(self.schema, name)
        if found is None:
            return missing()
        quoted = name.replace("`", "``")
        return resolve(rest, Value(F.col(f"`{quoted}`"), found.dataType, found.metadata.get("bson")))


@dataclass(frozen=True)
class Element:
    """An element of an array as a root: documents by field, others by the empty path."""

    value: Value

    def at(self, path: str) -> Value:
        if isinstance(self.value.kind, T.StructType):
            return resolve(path, self.value) if path else missing()
        return self.value if path == "" else missing()

"""Projections: inclusion, exclusion, nested paths through arrays, positional elements and slices."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions.paths import Row, Value, field_of
from bramble.operators.positional import matched_index
from bramble.plans.bql import And, BqlError
from bramble.plans.compiler import Compiler

ID = "_id"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _tree(names: list[str]) -> dict:
    out: dict = {}
    for name in names:
        at = out
        parts = name.split(".")
        for i, part in enumerate(parts):
            if part in at and (at[part] is None or i == len(parts) - 1):
                raise BqlError(f"path collision at {name!r}")
            at = at.setdefault(part, None if i == len(parts) - 1 else {})
    return out


def _checked_slice(spec: Any) -> int | tuple[int, int]:
    """A $slice: a number, or (skip, limit)."""
    if isinstance(spec, bool) or not isinstance(spec, int | list | tuple):
        raise BqlError("$slice takes a number or [skip, limit]")
    if isinstance(spec, int):
        return spec
    if len(spec) != 2 or not all(isinstance(x, int) for x in spec) or spec[1] <= 0:
        raise BqlError("$slice takes [skip, limit] with a positive limit")
    return tuple(spec)


def _slice(column: Column, spec: int | tuple[int, int]) -> Column:
    size = F.size(column)
    if isinstance(spec, int):
        if spec >= 0:
            return F.slice(column, 1, spec)
        return F.when(size <= -spec, column).otherwise(F.slice(column, spec, -spec))
    skip, limit = spec
    start = F.lit(skip) if skip >= 0 else F.greatest(size + skip, F.lit(0))
    return F.slice(column, start + 1, F.lit(limit))


def _included(column: Column, kind: T.DataType, tree: dict | None) -> Column | None:
    """The parts of a value that the tree names; None where it names nothing there."""
    if tree is None:
        return column
    if isinstance(kind, T.StructType):
        parts = []
        for name, below in tree.items():
            found = field_of(kind, name)
            part = _included(column.getField(name), found.dataType, below) if found else None
            if part is not None:
                parts.append(part.alias(name))
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        if _included(F.lit(None), kind.elementType, tree) is None:
            return None
        return F.transform(column, lambda e: _included(e, kind.elementType, tree))
    return None


def _excluded(column: Column, kind: T.DataType, tree: dict) -> Column:
    if isinstance(kind, T.StructType):
        out = column
        gone = [n for n, below in tree.items() if below is None and field_of(kind, n)]
        for name, below in tree.items():
            found = field_of(kind, name)
            if found and below is not None:
                out = out.withField(name, _excluded(column.getField(name), found.dataType, below))
        return out.dropFields(*gone) if gone else out
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda e: _excluded(e, kind.elementType, tree))
    return column


@dataclass(frozen=True)
class Projection:
    """A checked projection: its mode and what it names."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    slices: Mapping[str, Any] = field(default_factory=dict)
    positional: str | None = None
    keep_id: bool = True
    only_id: bool = False

    @classmethod
    def of(cls, spec: Mapping[str, Any], id_col: str = ID) -> Projection:
        include, exclude, slices, positional = [], [], {}, None
        for name, value in spec.items():
            if name == id_col and value in (0, 1, True, False):
                continue
            if isinstance(value, Mapping):
                if set(value) != {"$slice"}:
                    raise BqlError(f"unknown projection operator at {name!r}")
                slices[name] = _checked_slice(value["$slice"])
            elif name.endswith(".$"):
                if positional or not value:
                    raise BqlError("one positional operator, in an inclusion, is allowed")
                positional = name[:-2]
            elif ".$" in name:
                raise BqlError("a positional operator comes last")
            elif value in (1, True):
                include.append(name)
            elif value in (0, False):
                exclude.append(name)
            else:
                raise BqlError(f"unknown projection value at {name!r}")
        if exclude and (include or positional):
            raise BqlError("inclusion and exclusion do not mix")
        for path in slices:
            if path in include or path in exclude or any(p.startswith(path + ".") or path.startswith(p + ".") for p in (*include, *exclude)):
                raise BqlError(f"path collision at {path!r}")
        if positional:
            include.append(positional)
        _tree([*include, *slices])
        _tree(exclude)
        only_id = spec.get(id_col) in (1, True) and not (include or exclude or slices)
        return cls(tuple(include), tuple(exclude), slices, positional, bool(spec.get(id_col, True)), only_id)


def project(df: DataFrame, spec: Mapping[str, Any], query: Any = And(()), id_col: str = ID) -> DataFrame:  # noqa: B008
    """df with the fields of a projection; query tells which element a positional path means."""
    if not spec:
        return df
    what = Projection.of(spec, id_col)
    exclude = list(what.exclude)
    compiler = Compiler(df.schema)
    replaced: dict[str, Column] = {}
    for path, body in what.slices.items():
        value = Row(df.schema).at(path)
        if value.is_array:
            replaced[path] = _slice(value.column, body)
    if what.positional:
        value = Row(df.schema).at(what.positional)
        if value.is_array:
            at = matched_index(compiler, value, what.positional, query)
            replaced[what.positional] = F.when(F.size(value.column) == 0, value.column).otherwise(F.array(F.get(value.column, F.coalesce(at, F.lit(0)))))

    if replaced:
        df = replace_paths(df, replaced)
    schema = df.schema
    if what.include or what.only_id:
        tree = _tree([*what.include, *what.slices])
        columns = [_quoted(id_col)] if what.keep_id and id_col in df.columns else []
        for name, below in tree.items():
            found = field_of(schema, name)
            part = _included(_quoted(name), found.dataType, below) if found and name != id_col else None
            if part is not None:
                columns.append(part.alias(name))
        return df.select(*columns)
    if not what.keep_id:
        exclude.append(id_col)
    tree = _tree(exclude)
    return df.select(*[(_quoted(f.name) if f.name not in tree else _excluded(_quoted(f.name), f.dataType, tree[f.name])).alias(f.name) for f in schema.fields if f.name not in tree or tree[f.name] is not None])


def set_in(value: Value, segments: list[str], new: Column) -> Column:
    """value with new at a path of document fields."""
    if not segments:
        return new
    head, *rest = segments
    found = field_of(value.kind, head)
    inner = set_in(Value(value.column.getField(head), found.dataType), rest, new)
    return F.when(value.column.isNotNull(), value.column.withField(head, inner))


def replace_paths(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with other values at paths that exist and lead through documents alone."""
    for path, new in columns.items():
        head, *rest = path.split(".")
        root = Value(_quoted(head), field_of(df.schema, head).dataType)
        df = df.withColumn(head, set_in(root, rest, new))
    return df

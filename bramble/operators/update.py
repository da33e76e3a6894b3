"""Updates and deletes as transformations: a new DataFrame, and the ids that changed."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions.paths import Element, Row, Value, field_of
from bramble.operators.positional import matched_index
from bramble.operators.sort import natural_order
from bramble.plans.bql import And, BqlError, Leaf, parse
from bramble.plans.compiler import Compiler

UNSET = object()
#: An update limited to so many rows marks them by a broadcast of their ids; a larger limit joins.
BROADCAST_LIMIT = 100_000
_FILTER = re.compile(r"\$\[([A-Za-z][A-Za-z0-9_]*)\]")


@dataclass(frozen=True)
class Update:
    """A parsed update document: $unset runs before $set."""

    sets: tuple = ()
    unsets: tuple = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    upsert: bool = False

    @classmethod
    def of(cls, spec: Mapping[str, Any], id_col: str = "_id") -> Update:
        if unknown := set(spec) - {"$set", "$unset", "array_filters", "upsert"}:
            raise BqlError(f"unknown update operators {sorted(unknown)}")
        unset = spec.get("$unset", ())
        sets, unsets = tuple(spec.get("$set", {}).items()), tuple(unset)
        if not sets and not unsets:
            raise BqlError("an update needs $set or $unset")
        named = [p for p, _ in sets] + list(unsets)
        if any(p == id_col or p.startswith(id_col + ".") for p in named):
            raise BqlError(f"{id_col} is immutable")
        filters = _filters(spec.get("array_filters", ()))
        used = {m[1] for p in named for m in _FILTER.finditer(p)}
        if missing := used - set(filters):
            raise BqlError(f"no array filter for {sorted(missing)}")
        upsert = bool(spec.get("upsert", False))
        if upsert and any("$" in p for p in named):
            raise BqlError("an upsert takes no positional operators")
        return cls(sets, unsets, filters, upsert)


def _filters(given: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    out = {}
    for one in given:
        if len(one) != 1:
            raise BqlError("an array filter has one key")
        (name, body), = one.items()
        head, _, rest = name.partition(".")
        if isinstance(body, Mapping):
            if len(body) != 1:
                raise BqlError("an array filter has one operator")
            op = next(iter(body))
            if op.removeprefix("$") not in ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "all", "size", "exists"):
                raise BqlError(f"unknown array filter operator {op}")
            body = {"$" + op.removeprefix("$"): body[op]}
        out[head] = parse({rest or "element": body})
        if not rest:
            leaf = out[head]
            out[head] = Leaf(leaf.op, "", leaf.value)
    return out


def constant(value: Any, kind: T.DataType | None = None) -> Column:
    """A Python value as a column, of the given type where it can hold it."""
    if value is None:
        return F.lit(None).cast(kind) if kind is not None else F.lit(None)
    if isinstance(value, Mapping):
        if kind is not None and not isinstance(kind, T.StructType):
            raise BqlError("a document does not fit the field's type")
        fields = {f.name: f.dataType for f in kind.fields} if kind else {}
        if kind and set(value) - set(fields):
            raise BqlError(f"fields {sorted(set(value) - set(fields))} are not in the document's type")
        names = list(fields) if kind else list(value)
        return F.struct(*[constant(value.get(n), fields.get(n)).alias(n) for n in names])
    if isinstance(value, list | tuple):
        if kind is not None and not isinstance(kind, T.ArrayType):
            raise BqlError("an array does not fit the field's type")
        inner = kind.elementType if kind else None
        out = F.array(*[constant(v, inner) for v in value])
        return out.cast(kind) if kind else out
    fits = {T.StringType: str, T.BooleanType: bool, T.BinaryType: bytes, T.TimestampType: datetime, T.TimestampNTZType: datetime}
    if kind is not None:
        want = next((p for t, p in fits.items() if isinstance(kind, t)), (int, float, Decimal) if isinstance(kind, T.NumericType) else None)
        if want is None or not isinstance(value, want) or isinstance(value, bool) and want is not bool:
            raise BqlError(f"{value!r} does not fit {kind.simpleString()}")
        if isinstance(kind, T.IntegralType) and value != int(value):
            raise BqlError(f"{value!r} does not fit {kind.simpleString()}")
        return F.lit(value).cast(kind)
    return F.lit(value)


class _Assigner:
    def __init__(self, compiler: Compiler, update: Update, query: Any) -> None:
        self.compiler, self.update, self.query = compiler, update, query

    def assign(self, value: Value, segments: list[str], new: Any, path: str) -> Column:
        """value with new (or UNSET) at the segments below it; unchanged where they lead nowhere."""
        if not segments:
            return F.lit(None).cast(value.kind) if new is UNSET else constant(new, value.kind)
        head, *rest = segments
        if isinstance(value.kind, T.StructType):
            return self._document(value, head, rest, new, path)
        if isinstance(value.kind, T.ArrayType):
            return self._array(value, head, rest, new, path)
        return value.column

    def _document(self, value: Value, head: str, rest: list[str], new: Any, path: str) -> Column:
        found = field_of(value.kind, head)
        if found is None:
            if new is UNSET or any("$" in s for s in rest):
                return value.column
            made = new
            for s in reversed(rest):
                made = {s: made}
            return F.when(value.column.isNotNull(), value.column.withField(head, constant(made)))
        inner = self.assign(Value(value.column.getField(head), found.dataType), rest, new, f"{path}.{head}")
        kept = value.column.withField(head, inner)
        if new is UNSET or any("$" in s for s in rest):
            return F.when(value.column.isNotNull(), kept)
        blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in value.kind.fields])
        lone = self.assign(Value(F.lit(None).cast(found.dataType), found.dataType), rest, new, f"{path}.{head}")
        return F.when(value.column.isNotNull(), kept).otherwise(blank.withField(head, lone))

    def _array(self, value: Value, head: str, rest: list[str], new: Any, path: str) -> Column:
        inner = value.kind.elementType

        def rewritten(hit) -> Column:
            return F.transform(value.column, lambda e, i: F.when(hit(e, i), self.assign(Value(e, inner), rest, new, path)).otherwise(e))

        last = new is UNSET and not rest
        if head == "$[]":
            return F.when(value.column.isNotNull(), F.array().cast(value.kind)) if last else rewritten(lambda e, i: F.lit(True))
        if head == "$":
            at = matched_index(self.compiler, value, path, self.query)
            return rewritten(lambda e, i: i.eqNullSafe(at))
        if named := _FILTER.fullmatch(head):
            tree = self.update.filters[named[1]]
            met = lambda e: self.compiler.value(tree, Element(Value(e, inner)))
            return F.filter(value.column, lambda e: ~met(e)) if last else rewritten(lambda e, i: met(e))
        if head.isdigit():
            n = int(head)
            return F.filter(value.column, lambda e, i: i != n) if last else rewritten(lambda e, i: i == n)
        return value.column

    def column(self, df: DataFrame, path: str, new: Any) -> tuple[str, Column]:
        head, *rest = path.split(".")
        found = field_of(df.schema, head)
        if found is None:
            if new is UNSET or any("$" in s for s in rest):
                return head, None
            made = new
            for s in reversed(rest):
                made = {s: made}
            return head, constant(made)
        return head, self.assign(Row(df.schema).at(head), rest, new, head)


@dataclass(frozen=True)
class Changed:
    """The table after a change, and the ids of the rows that it changed."""

    table: DataFrame
    ids: DataFrame


def _marked(df: DataFrame, tree: Any, compiler: Compiler, id_col: str, limit: int | None, order: Sequence[Column] | None) -> tuple[DataFrame, Column]:
    """df with a column that tells which rows a change is for, and that column."""
    mark = "__hit"
    if limit is None:
        return df.withColumn(mark, compiler.value(tree)), F.col(mark)
    ids = df.where(compiler.condition(tree)).orderBy(*(order or natural_order(id_col))).limit(limit).select(F.col(id_col), F.lit(True).alias(mark))
    ids = F.broadcast(ids) if limit <= BROADCAST_LIMIT else ids
    return df.join(ids, id_col, "left").select(*df.columns, F.coalesce(mark, F.lit(False)).alias(mark)), F.col(mark)


def update(df: DataFrame, query: Any, spec: Mapping[str, Any], *, id_col: str = "_id", limit: int | None = None, order: Sequence[Column] | None = None, new_id: Any = None, collation: Any = None) -> Changed:
    """Applies an update document to the rows that a query matches, the first of them in order where limited."""
    tree = parse(query) if isinstance(query, str | bytes | Mapping) else query
    what = Update.of(spec, id_col)
    compiler = Compiler(df.schema, collation)
    if what.upsert and df.where(compiler.condition(tree)).isEmpty():
        row = _upserted(df, tree, what, id_col, new_id)
        return Changed(df.unionByName(row, allowMissingColumns=True), row.select(id_col))
    marked, hit = _marked(df, tree, compiler, id_col, limit, order)
    old = marked.select("*", F.struct(*[F.col(f"`{c}`") for c in df.columns if c != id_col]).alias("__old"))
    now = old
    assigner = _Assigner(compiler, what, tree)
    for path, new in [*((p, UNSET) for p in what.unsets), *what.sets]:
        name, column = assigner.column(now, path, new)
        if column is None:
            continue
        before = F.col(f"`{name}`") if name in now.columns else F.lit(None)
        now = now.withColumn(name, F.when(hit, column).otherwise(before))
    after = F.struct(*[F.col(f"`{c}`") for c in now.columns if c not in (id_col, "__old", "__hit")])
    new_fields = len(now.columns) > len(old.columns)
    changed = now.where(hit if new_fields else hit & ~after.eqNullSafe(F.col("__old"))).select(id_col)
    return Changed(now.drop("__old", "__hit"), changed)


def equalities(tree: Any) -> list[Leaf]:
    if isinstance(tree, And):
        return [x for c in tree.children for x in equalities(c)]
    return [tree] if isinstance(tree, Leaf) and tree.op == "eq" else []


def _upserted(df: DataFrame, tree: Any, what: Update, id_col: str, new_id: Any) -> DataFrame:
    """One row: the query's equality conditions, then what is set."""
    document: dict[str, Any] = {}

    def put(path: str, value: Any) -> None:
        at = document
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value

    for leaf in equalities(tree):
        put(leaf.path, leaf.value.value)
    for path, value in what.sets:
        put(path, value)
    if id_col not in document:
        if new_id is None:
            raise BqlError("an upsert that inserts needs an id")
        document[id_col] = new_id
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def full(value: Any, kind: T.DataType | None) -> Column:
        if isinstance(value, Mapping) and isinstance(kind, T.StructType):
            extra = set(value) - set(kind.fieldNames())
            if extra:
                raise BqlError(f"fields {sorted(extra)} are not in the document's type")
        return constant(value, kind)

    return df.sparkSession.range(1).select(*[full(v, kinds.get(n)).alias(n) for n, v in document.items()])


def delete(df: DataFrame, query: Any, *, id_col: str = "_id", limit: int | None = None, compiler: Compiler | None = None) -> Changed:
    """df without the rows that a query matches, or without the first of them by id."""
    tree = parse(query) if isinstance(query, str | bytes | Mapping) else query
    compiler = compiler or Compiler(df.schema)
    if limit is None:
        return Changed(df.where(~compiler.value(tree)), df.where(compiler.condition(tree)).select(id_col))
    ids = df.where(compiler.condition(tree)).orderBy(*natural_order(id_col)).limit(limit).select(id_col)
    return Changed(df.join(F.broadcast(ids) if limit <= BROADCAST_LIMIT else ids, id_col, "left_anti").select(*df.columns), ids)

"""Projections and updates of schemaless documents (one VARIANT column).

A document may hold any type in any field, which no typed column expresses, so
the change of a matched document runs in Python on its JSON, in Arrow batches;
the match itself stays a native condition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.operators.positional import element_condition
from bramble.operators.project import Projection
from bramble.operators.sort import natural_order
from bramble.operators.update import UNSET, Changed, Update, equalities
from bramble.plans import evaluator
from bramble.plans.bql import And, parse
from bramble.plans.dynamic import DynamicCompiler
from bramble.sources.documents import DOCUMENT


def _element(e: Any) -> Any:
    return e if isinstance(e, Mapping) else {"": e}


def _first(items: list, path: str, tree: Any) -> int | None:
    """The index of the element that the query singles out; 0 where it leaves the array alone."""
    condition = element_condition(tree, path)
    if condition is None:
        return 0
    return next((i for i, e in enumerate(items) if evaluator.test(condition, _element(e))), None)


# projections


def project_document(document: dict, what: Projection, tree: Any) -> dict:
    out = json.loads(json.dumps(document))
    for path, spec in what.slices.items():
        _replace(out, path.split("."), lambda v, spec=spec: _cut(v, spec))
    if what.positional:
        _replace(out, what.positional.split("."), lambda v: _one(v, what.positional, tree))
    if what.include or what.only_id:
        kept: dict = {}
        for path in (*what.include, *what.slices):
            _copy(out, kept, path.split("."))
        return kept
    for path in what.exclude:
        _remove(out, path.split("."))
    return out


def _cut(value: Any, spec: Any) -> Any:
    if not isinstance(value, list):
        return value
    if isinstance(spec, int):
        return value[:spec] if spec >= 0 else value[spec:]
    skip, limit = spec
    start = skip if skip >= 0 else max(len(value) + skip, 0)
    return value[start : start + limit]


def _one(value: Any, path: str, tree: Any) -> Any:
    if not isinstance(value, list) or not value:
        return value
    return [value[_first(value, path, tree) or 0]]


def _replace(value: Any, segments: list[str], change) -> None:
    head, *rest = segments
    if isinstance(value, dict) and head in value:
        if rest:
            _replace(value[head], rest, change)
        else:
            value[head] = change(value[head])


def _copy(source: dict, target: dict, segments: list[str]) -> None:
    """Adds the part of source at a path to target, element by element through arrays."""
    head, *rest = segments
    if head not in source:
        return
    value = source[head]
    if not rest:
        target[head] = value
    elif isinstance(value, dict):
        _copy(value, target.setdefault(head, {}), rest)
    elif isinstance(value, list):
        documents = [e for e in value if isinstance(e, dict)]
        made = target.setdefault(head, [{} for _ in documents])
        for e, into in zip(documents, made, strict=True):
            _copy(e, into, rest)


def _remove(value: Any, segments: list[str]) -> None:
    head, *rest = segments
    if isinstance(value, list):
        for e in value:
            _remove(e, segments)
    elif isinstance(value, dict) and head in value:
        if rest:
            _remove(value[head], rest)
        else:
            del value[head]


# updates


def change_document(document: dict, what: Update, tree: Any) -> dict:
    """The document after an update: every $unset, then every $set."""
    out = json.loads(json.dumps(document))
    places = {}
    for array in _arrays(what):
        items = evaluator.select(document, array)
        at = _first(items, array, tree) if isinstance(items, list) else None
        if at is not None:
            places[array] = at
    for path in what.unsets:
        _assign(out, path.split("."), UNSET, "", what, places)
    for path, value in what.sets:
        _assign(out, path.split("."), value, "", what, places)
    return out


def _arrays(what: Update) -> set[str]:
    """The arrays that a positional $ speaks of."""
    return {p[: p.index(".$")] for p in (*what.unsets, *(p for p, _ in what.sets)) if p.endswith(".$") or ".$." in p}


def _assign(value: Any, segments: list[str], new: Any, path: str, what: Update, places: Mapping[str, int]) -> None:
    head, *rest = segments
    below = f"{path}.{head}" if path else head
    if isinstance(value, dict):
        if not rest:
            if new is UNSET:
                value.pop(head, None)
            else:
                value[head] = new
            return
        if head not in value:
            if new is UNSET or rest[0].startswith("$"):
                return
            value[head] = [] if rest[0].isdigit() else {}
        if rest[0].startswith("$") and not isinstance(value[head], list):
            return
        _assign(value[head], rest, new, below, what, places)
    elif isinstance(value, list):
        _assign_elements(value, head, rest, new, path, what, places)


def _assign_elements(items: list, head: str, rest: list[str], new: Any, path: str, what: Update, places: Mapping[str, int]) -> None:
    if head == "$[]":
        hits = range(len(items))
    elif head == "$":
        hits = [places[path]] if path in places and places[path] < len(items) else []
    elif head.startswith("$[") and head.endswith("]"):
        condition = what.filters[head[2:-1]]
        hits = [i for i, e in enumerate(items) if evaluator.test(condition, _element(e))]
    else:
        hits = [int(head)] if head.isdigit() and int(head) < len(items) else []
    if rest:
        for i in hits:
            _assign(items[i], rest, new, path, what, places)
    elif new is not UNSET:
        for i in hits:
            items[i] = new
    elif head == "$":
        for i in hits:
            items[i] = None
    else:
        gone = set(hits)
        items[:] = [e for i, e in enumerate(items) if i not in gone]


# over tables


def _mapped(df: DataFrame, change, id_col: str) -> DataFrame:
    """df with change applied to each document; the id column and the document are all there is."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(change(json.loads(t))) if t is not None else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "json"])

    texts = df.select(id_col, F.to_json(DOCUMENT).alias("json")).mapInArrow(run, f"`{id_col}` {kind}, json string")
    return texts.select(id_col, F.parse_json("json").alias(DOCUMENT))


def project_dynamic(df: DataFrame, spec: Mapping[str, Any], query: Any = And(()), id_col: str = "_id") -> DataFrame:  # noqa: B008
    if not spec:
        return df
    what = Projection.of(spec, id_col)
    rows = _mapped(df, lambda d: project_document(d, what, query), id_col)
    return rows if what.keep_id else rows.select(DOCUMENT)


def update_dynamic(df: DataFrame, query: Any, spec: Mapping[str, Any], *, id_col: str = "_id", limit: int | None = None, order: Sequence[Column] | None = None, new_id: Any = None) -> Changed:
    """As the typed update, on documents of any shape."""
    tree = parse(query) if isinstance(query, str | bytes | Mapping) else query
    what = Update.of(spec, id_col)
    compiler = DynamicCompiler(DOCUMENT)
    matched = df.where(compiler.condition(tree))
    if what.upsert and matched.isEmpty():
        blank = Update(sets=(*((x.path, x.value.value) for x in equalities(tree)), *what.sets))
        text = json.dumps(change_document({}, blank, tree))
        row = df.sparkSession.range(1).select(F.lit(new_id).cast(df.schema[id_col].dataType).alias(id_col), F.parse_json(F.lit(text)).alias(DOCUMENT))
        return Changed(df.unionByName(row), row.select(id_col))
    if limit is not None:
        matched = matched.orderBy(*(order or natural_order(id_col))).limit(limit)
    now = _mapped(matched, lambda d: change_document(d, what, tree), id_col)
    rest = df.join(matched.select(id_col), id_col, "left_anti").select(id_col, DOCUMENT)
    before = matched.select(id_col, F.to_json(DOCUMENT).alias("before"))
    changed = now.select(id_col, F.to_json(DOCUMENT).alias("after")).join(before, id_col).where("before <> after").select(id_col)
    return Changed(rest.unionByName(now), changed)

"""The index of the first array element that a query's conditions on the array single out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from bramble.functions.paths import Element, Value
from bramble.plans.bql import And, Elem, Leaf, Or
from bramble.plans.compiler import Compiler


def element_condition(tree: Any, array: str) -> Any:
    """The part of a query that speaks of single elements of the array, on an element; None if there is none.

    Conditions under AND hold together, OR groups its branches; NOT and $size
    single out no element, and $all does so by any of its items.
    """
    match tree:
        case And(children):
            parts = [p for p in (element_condition(c, array) for c in children) if p is not None]
            return And(tuple(parts)) if parts else None
        case Or(children):
            parts = [p for p in (element_condition(c, array) for c in children) if p is not None]
            return Or(tuple(parts)) if parts else None
        case Elem(path, sub):
            return sub if path == array else None
        case Leaf(op, path, value) if op != "size":
            op = "in" if op == "all" else op
            if path == array:
                return Leaf(op, "", value)
            if path.startswith(array + "."):
                return Leaf(op, path[len(array) + 1 :], value)
    return None


def first_index(compiler: Compiler, array: Value, condition: Any) -> Column:
    """The zero-based index of the first element that meets the condition, or null."""
    inner = array.kind.elementType
    met = F.transform(array.column, lambda e, i: F.when(compiler.value(condition, Element(Value(e, inner, array.bson))), i))
    return F.get(F.filter(met, lambda i: i.isNotNull()), F.lit(0))


def matched_index(compiler: Compiler, array: Value, path: str, tree: Any) -> Column:
    """As first_index, for a whole query; the first element where the query leaves the array alone."""
    condition = element_condition(tree, path)
    return F.lit(0) if condition is None else first_index(compiler, array, condition)



"""Which index would serve a query: the access path, for explain and for choosing a sorted layout.

Spark scans files; an access path here names the layout whose row groups the
query's bounds prune best, and what remains to be tested.  The choice: the id
first, then a compound index by its longest prefix of equalities with at most
one range after it, then a single-field index, by estimated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from bramble.plans.bql import COMPARISONS, And, Const, Elem, Leaf, Literal, Not, Or
from bramble.plans.normalize import explain

_TYPES = {"int32": {"int32", "int64", "double"}, "int64": {"int64"}, "double": {"double", "int32"}}


@dataclass(frozen=True)
class Histogram:
    """Buckets (low, high, values) of an index's first field, and its entries."""

    buckets: tuple
    entries: int

    def fraction(self, op: str, value: Any) -> float:
        """The share of entries that a one-sided comparison keeps."""
        total = sum(n for _, _, n in self.buckets) or 1
        below = 0.0
        for low, high, n in self.buckets:
            below += n if high < value else n / 2 if low <= value else 0
        below /= total
        return below if op in ("lt", "lte") else 1.0 - below


@dataclass(frozen=True)
class Path:
    """node: FULL_SCAN, INDEX_SCAN, RANGE_SCAN, COMPOUND_SCAN, UNION, ORDERED_CONCAT or EMPTY."""

    node: str
    index: str | None = None
    bounds: tuple = ()
    residual: Any = Const(True)
    children: tuple = ()
    rows: float | None = None

    def lines(self, indent: int = 0) -> list[str]:
        pad = "  " * indent
        shown = f"{pad}{self.node}" + (f" {self.index}" if self.index else "") + (f" ~{self.rows:.0f} rows" if self.rows is not None else "")
        out = [shown, *(f"{pad}  {explain(b)}" for b in self.bounds)]
        for child in self.children:
            out += child.lines(indent + 1)
        if self.residual != Const(True):
            out += [f"{pad}  RESIDUAL", explain(self.residual, indent + 2)]
        return out


def _usable(leaf: Any, index: Any) -> bool:
    """Whether an index orders what the leaf compares: same type, and no negation over several keys."""
    if not isinstance(leaf, Leaf) or leaf.op not in ("eq", *COMPARISONS, "in") or index.status != "READY" or index.kind == "vector":
        return False
    values = leaf.value if leaf.op == "in" else (leaf.value,)
    kind = index.types[index.fields.index(leaf.path)] if index.types else None
    return all(isinstance(v, Literal) and v.kind != "regex" and (kind is None or v.is_null or v.kind in _TYPES.get(kind, {kind})) for v in values)


def _rest(leaves: list, used: list) -> Any:
    left = [x for x in leaves if not any(x is u for u in used)]
    return Const(True) if not left else left[0] if len(left) == 1 else And(tuple(left))


def _estimate(bounds: list, index: Any, histograms: Mapping[str, Histogram]) -> float | None:
    known = histograms.get(index.name)
    if known is None:
        return None
    share = 1.0
    for leaf in bounds:
        if leaf.path == index.fields[0] and leaf.op in COMPARISONS and leaf.value.is_numeric:
            share *= known.fraction(leaf.op, leaf.value.value)
        elif leaf.op == "eq":
            share *= 1.0 / max(1, sum(n for _, _, n in known.buckets))
    return share * known.entries


def _candidates(leaves: list, indexes: Mapping[str, Any], id_col: str, histograms: Mapping[str, Histogram]) -> list[tuple]:
    """(order, path) of each index that the conjunction can use; the least is the best."""
    out = []
    own = [x for x in leaves if isinstance(x, Leaf) and x.path == id_col and x.op in ("eq", *COMPARISONS)]
    if own:
        out.append(((0, 0, 0.0), Path("INDEX_SCAN" if len(own) == 1 else "RANGE_SCAN", "primary", tuple(own), _rest(leaves, own))))
    for index in indexes.values():
        used: list = []
        for i, field in enumerate(index.fields):
            here = [x for x in leaves if isinstance(x, Leaf) and x.path == field and _usable(x, index) and x.op != "in"]
            equal = [x for x in here if x.op == "eq"][:1]
            used += equal or here[: 1 if index.multi_key else 2]
            if not equal or i + 1 == len(index.fields):
                break
        if not used:
            continue
        ranged = len(used) > 1
        node = "COMPOUND_SCAN" if index.kind == "compound" else "RANGE_SCAN" if ranged else "INDEX_SCAN"
        rows = _estimate(used, index, histograms)
        equalities = sum(x.op == "eq" for x in used)
        order = (1, -len(used), float("inf") if rows is None else rows) if index.kind == "compound" and len(used) > 1 else (2, -equalities, float("inf") if rows is None else rows)
        out.append((order, Path(node, index.name, tuple(used), _rest(leaves, used), rows=rows)))
    return sorted(out, key=lambda x: (x[0], x[1].index or ""))


def access_path(tree: Any, indexes: Mapping[str, Any], id_col: str = "_id", sort_field: str | None = None, histograms: Mapping[str, Histogram] | None = None) -> Path:
    """The path for a normalised query; negations, element matches and regular expressions are always residual."""
    histograms = histograms or {}
    if tree == Const(False):
        return Path("EMPTY")
    if tree == Const(True):
        sorted_by = next((i.name for i in indexes.values() if sort_field and i.fields == (sort_field,)), None)
        return Path("RANGE_SCAN", sorted_by) if sorted_by else Path("FULL_SCAN")
    if isinstance(tree, Or):
        parts = [access_path(c, indexes, id_col, None, histograms) for c in tree.children]
        if all(p.node not in ("FULL_SCAN", "EMPTY") for p in parts):
            return Path("UNION", children=tuple(parts))
        return Path("FULL_SCAN", residual=tree)
    if isinstance(tree, Leaf) and tree.op == "in":
        single = next((i for i in indexes.values() if i.fields == (tree.path,) and _usable(tree, i)), None)
        if single:
            parts = tuple(Path("INDEX_SCAN", single.name, (Leaf("eq", tree.path, v),)) for v in tree.value)
            return Path("ORDERED_CONCAT" if sort_field == tree.path else "UNION", children=parts)
        return Path("FULL_SCAN", residual=tree)
    leaves = list(tree.children) if isinstance(tree, And) else [tree]
    found = _candidates(leaves, indexes, id_col, histograms)
    return found[0][1] if found else Path("FULL_SCAN", residual=tree)


def shape(tree: Any) -> str:
    """A digest of a query without its literals and the order of its conditions: what a plan can be kept under."""
    return hashlib.sha256(_shape(tree).encode()).hexdigest()[:16]


def _shape(tree: Any) -> str:
    match tree:
        case And(children) | Or(children):
            return f"{type(tree).__name__}({','.join(sorted(map(_shape, children)))})"
        case Not(child):
            return f"Not({_shape(child)})"
        case Elem(path, sub):
            return f"Elem({path!r},{_shape(sub)})"
        case Leaf(op, path, value):
            kinds = sorted({v.kind for v in value}) if isinstance(value, tuple) else value.kind if isinstance(value, Literal) else type(value).__name__
            return f"{op}({path!r},{kinds})"
    return str(tree)

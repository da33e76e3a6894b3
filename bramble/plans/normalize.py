"""Rewrites of a query tree that keep its meaning, and the tree as text for explain.

Contradictions and subsumption are settled for scalar columns only: two
conditions on an array may be met by two elements.  Bounds are compared exactly.
"""

from __future__ import annotations

from typing import Any

from bramble.functions.numeric import as_decimal
from bramble.plans.bql import And, Const, Elem, Leaf, Literal, Not, Or, plain

#: Cheap conditions first; generated code keeps the order.
_COST = {"eq": 0, "size": 1, "exists": 1, "gt": 2, "gte": 2, "lt": 2, "lte": 2, "in": 3, "nin": 4, "ne": 4, "all": 5, "regex": 6}


def _key(value: Literal) -> Any:
    """What orders literals of one bracket; None where there is no order."""
    if value.is_numeric:
        return ("number", as_decimal(value)) if as_decimal(value) is not None else None
    if value.kind in ("string", "datetime", "objectid", "timestamp"):
        return (value.kind, value.value)
    return None


def normalize(tree: Any, scalar=lambda path: False) -> Any:
    """tree simplified; scalar tells whether a path is known to hold no array."""
    match tree:
        case And(children) | Or(children):
            kind = type(tree)
            done: list = []
            for child in (normalize(c, scalar) for c in children):
                done += child.children if isinstance(child, kind) else [child]
            stop = Const(kind is Or)
            done = [c for c in dict.fromkeys(done) if c != Const(kind is And)]
            if stop in done or kind is And and _contradicts(done, scalar):
                return stop
            if kind is And:
                done = _tightest(done, scalar)
            if not done:
                return Const(kind is And)
            done.sort(key=_cost)
            return done[0] if len(done) == 1 else kind(tuple(done))
        case Not(child):
            inner = normalize(child, scalar)
            if isinstance(inner, Not):
                return inner.child
            return Const(not inner.value) if isinstance(inner, Const) else Not(inner)
        case Elem(path, sub):
            if sub == And(()):
                return Const(True)
            inner = normalize(sub, scalar)
            return Const(False) if inner == Const(False) else Elem(path, inner)
        case Leaf("in", _, ()):
            return Const(False)
        case Leaf("nin", _, ()):
            return Const(True)
    return tree


def _cost(tree: Any) -> int:
    match tree:
        case Leaf(op, _, _):
            return _COST[op]
        case Elem():
            return 8
        case And(children) | Or(children):
            return 10 + max(map(_cost, children), default=0)
        case Not(child):
            return 1 + _cost(child)
    return 0


def _bounds(leaves: list, scalar) -> dict[tuple, list]:
    found: dict[tuple, list] = {}
    for leaf in leaves:
        if isinstance(leaf, Leaf) and leaf.op in ("eq", "ne", "gt", "gte", "lt", "lte") and isinstance(leaf.value, Literal) and scalar(leaf.path):
            key = _key(leaf.value)
            if key:
                found.setdefault((leaf.path, key[0]), []).append((leaf, key[1]))
    return found


def _admits(op: str, bound: Any, value: Any) -> bool:
    return {"eq": value == bound, "ne": value != bound, "gt": value > bound, "gte": value >= bound, "lt": value < bound, "lte": value <= bound}[op]


def _contradicts(leaves: list, scalar) -> bool:
    """Whether no scalar can meet all the conditions of one path."""
    for conditions in _bounds(leaves, scalar).values():
        for leaf, value in conditions:
            if leaf.op == "eq" and not all(_admits(other.op, bound, value) for other, bound in conditions):
                return True
        low = max(((v, leaf.op == "gt") for leaf, v in conditions if leaf.op in ("gt", "gte")), default=None)
        high = min(((v, leaf.op != "lt") for leaf, v in conditions if leaf.op in ("lt", "lte")), default=None)
        if low and high and (low[0] > high[0] or low[0] == high[0] and (low[1] or not high[1])):
            return True
    return False


def _tightest(leaves: list, scalar) -> list:
    """Without range conditions that a tighter one, or an equality, implies."""
    drop: set[int] = set()
    for conditions in _bounds(leaves, scalar).values():
        equal = [v for leaf, v in conditions if leaf.op == "eq"]
        if equal:
            drop |= {id(leaf) for leaf, _ in conditions if leaf.op != "eq"}
            continue
        for ops, best in ((("gt", "gte"), max), (("lt", "lte"), min)):
            of = [(v, (leaf.op in ("gt",)) if best is max else (leaf.op != "lt"), leaf) for leaf, v in conditions if leaf.op in ops]
            if len(of) > 1:
                keep = best(of, key=lambda x: x[:2])[2]
                drop |= {id(leaf) for _, _, leaf in of if leaf is not keep}
    return [x for x in leaves if id(x) not in drop]


def explain(tree: Any, indent: int = 0) -> str:
    """The tree, a node a line."""
    pad = "  " * indent
    match tree:
        case And(children) | Or(children):
            return "\n".join([f"{pad}{type(tree).__name__.upper()}", *(explain(c, indent + 1) for c in children)])
        case Not(child):
            return f"{pad}NOT\n{explain(child, indent + 1)}"
        case Elem(path, sub):
            return f"{pad}ELEMMATCH {path}\n{explain(sub, indent + 1)}"
        case Leaf(op, path, value):
            shown = [plain(v) for v in value] if isinstance(value, tuple) else plain(value) if isinstance(value, Literal) else value
            return f"{pad}{op.upper()} {path or '<element>'} {shown!r}"
    return f"{pad}{str(tree.value).upper()}"

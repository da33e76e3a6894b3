"""Exact vector search: similarity, threshold, post-filter, top-k.

The scan computes the score with built-in array functions and the top-k is a
TakeOrderedAndProject: each task keeps k rows.  Scores: cosine (1 + cos) / 2,
euclidean 1 / (1 + d * d), dot product (1 + dot) / 2; the last two follow the
public formulas of a common graph index, an assumption.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions.paths import Row
from bramble.plans.bql import BqlError, parse
from bramble.plans.compiler import Compiler

DISTANCES = ("COSINE", "EUCLIDEAN", "DOT_PRODUCT")
SCORE = "_score"
DEFAULT_TOP, DEFAULT_CANDIDATES = 10, 10_000


def query_vector(vector: Sequence[float] | bytes, dimensions: int | None) -> list[float]:
    """A checked query vector from numbers or little-endian 32-bit floats."""
    if isinstance(vector, bytes | bytearray):
        if len(vector) % 4:
            raise BqlError("a binary vector is a sequence of 32-bit floats")
        vector = struct.unpack(f"<{len(vector) // 4}f", vector)
    out = []
    for x in vector:
        if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
            raise BqlError("a vector holds finite numbers")
        out.append(float(x))
    if not out or dimensions is not None and len(out) != dimensions:
        raise BqlError(f"the vector has {len(out)} dimensions, the index {dimensions}")
    return out


def _sum(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)


def similarity(column: Column, query: Sequence[float], distance: str = "COSINE") -> Column:
    """The score of a vector column against a constant; null for other lengths."""
    if distance not in DISTANCES:
        raise BqlError(f"unknown distance function {distance}")
    q = F.array(*[F.lit(float(x)) for x in query])
    doubles = column.cast("array<double>")
    pairs = lambda f: _sum(F.zip_with(doubles, q, f))
    if distance == "EUCLIDEAN":
        score = 1.0 / (1.0 + pairs(lambda a, b: (a - b) * (a - b)))
    elif distance == "DOT_PRODUCT":
        score = (1.0 + pairs(lambda a, b: a * b)) / 2.0
    else:
        norm = math.sqrt(sum(x * x for x in query))
        length = F.sqrt(_sum(F.transform(doubles, lambda a: a * a)))
        score = (1.0 + F.try_divide(pairs(lambda a, b: a * b), length * F.lit(norm))) / 2.0
    return F.when(F.size(column) == len(query), score)


def vector_search(
    df: DataFrame, path: str, vector: Sequence[float] | bytes, *, top: int = DEFAULT_TOP, threshold: float = 0.0, distance: str = "COSINE",
    query: Any = None, candidates: int | None = DEFAULT_CANDIDATES, dimensions: int | None = None, id_col: str = "_id", collation: Any = None,
) -> DataFrame:
    """The top rows by score, with the score; the filter sees the best candidates only, all of them where None."""
    value = Row(df.schema).at(path)
    if not value.is_array or not isinstance(value.kind.elementType, T.NumericType):
        raise BqlError(f"{path!r} is no vector")
    q = query_vector(vector, dimensions)
    scored = df.withColumn(SCORE, similarity(value.column, q, distance))
    scored = scored.where((F.col(SCORE) >= threshold) & F.col(SCORE).isNotNull())
    order = [F.col(SCORE).desc(), F.col(id_col)]
    if query is not None:
        if candidates is not None:
            scored = scored.orderBy(*order).limit(candidates)
        tree = parse(query) if isinstance(query, str | bytes | dict) else query
        scored = scored.where(Compiler(df.schema, collation).condition(tree))
    return scored.orderBy(*order).limit(top or DEFAULT_TOP)

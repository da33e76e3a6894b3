"""Lossless numeric comparison of a typed column with a literal.

The literal is known when the query is compiled, so the promotion to a common
type happens there: an integer column is compared with an integer bound, a
double column with a double bound, and the comparison stays one that a Parquet
scan can be given.
"""

from __future__ import annotations

import math
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.plans.bql import Literal

_RANGE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
_OPERATORS = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def apply(op: str, left: Column, right: Column) -> Column:
    return getattr(left, _OPERATORS[op])(right)


def as_decimal(value: Literal) -> Decimal | None:
    """The literal's exact decimal (the shortest one of a double); None for NaN and infinities."""
    if value.kind == "double":
        return Decimal(repr(value.value)) if math.isfinite(value.value) else None
    number = Decimal(value.value)
    return number if number.is_finite() else None


def _constant(column: Column, answer: bool) -> Column:
    """answer for every value, null for null."""
    return F.when(column.isNotNull(), F.lit(answer))


def compare(column: Column, kind: T.DataType, op: str, value: Literal) -> Column:
    """column op value, as if both were promoted without loss; null for a null column."""
    number = as_decimal(value)
    if isinstance(kind, T.IntegralType):
        if number is None:  # no integer equals or orders against NaN and infinities
            return _constant(column, op == "ne")
        return _integers(column, kind, op, number)
    if isinstance(kind, T.FloatType | T.DoubleType):
        wide = column if isinstance(kind, T.DoubleType) else column.cast("double")
        if value.kind == "double" or number is None:
            return apply(op, wide, F.lit(float(value.value)))
        return _doubles(wide, op, number)
    if number is None:
        return _constant(column, op == "ne")
    return apply(op, column, F.lit(number))


def _integers(column: Column, kind: T.DataType, op: str, number: Decimal) -> Column:
    floor = int(number.to_integral_value(ROUND_FLOOR))
    whole = number == floor
    bits = _RANGE[type(kind)]
    low, high = -(1 << bits), (1 << bits) - 1
    if op in ("eq", "ne"):
        if not whole or not low <= floor <= high:
            return _constant(column, op == "ne")
        return apply(op, column, F.lit(floor).cast(kind))
    # column > floor holds for column > number and, between integers, for column >= number
    if not whole:
        op = "gt" if op in ("gt", "gte") else "lte"
    if floor > high:
        return _constant(column, op in ("lt", "lte"))
    if floor < low:
        return _constant(column, op in ("gt", "gte"))
    return apply(op, column, F.lit(floor).cast(kind))


def _doubles(column: Column, op: str, number: Decimal) -> Column:
    try:
        near = float(number)
    except OverflowError:
        near = math.copysign(math.inf, number)
    if math.isinf(near):
        return _constant(column, op == "ne" or op in (("lt", "lte") if near > 0 else ("gt", "gte")))
    exact = Decimal(repr(near))
    if exact == number:
        return apply(op, column, F.lit(near))
    if op in ("eq", "ne"):
        return _constant(column, op == "ne")
    above = exact > number  # the nearest double is the first above the number, or the last below it
    return apply(("gte" if op in ("gt", "gte") else "lt") if above else ("gt" if op in ("gt", "gte") else "lte"), column, F.lit(near))

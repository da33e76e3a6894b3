"""The ordered key-value model over a DataFrame (key BINARY, value BINARY).

Binary columns order by unsigned bytes, as the model's keys do.  Writes give a
new DataFrame; a batch of mutations is folded by key in one aggregation.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from decimal import Context, Decimal, Inexact
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.plans.bql import BqlError

DDL = "key binary, value binary"
DEFAULT_LIMIT = 100
OPEN = "*"
SELECTORS = ("FIRST_GREATER_OR_EQUAL", "FIRST_GREATER_THAN", "LAST_LESS_THAN", "LAST_LESS_OR_EQUAL")
MUTATIONS = (
    "ADD", "BIT_AND", "BIT_OR", "BIT_XOR", "APPEND_IF_FITS", "MAX", "MIN", "SET_VERSIONSTAMPED_VALUE", "BYTE_MIN", "BYTE_MAX", "COMPARE_AND_CLEAR",
)
#: Bytes that a value may have.
MOST_VALUE = 100_000


def _bytes(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _key(x: str | bytes) -> Column:
    return F.lit(_bytes(x))


# numbers


def encode_i64(n: int) -> bytes:
    return struct.pack("<q", n)


def encode_f64(x: float) -> bytes:
    if not math.isfinite(x):
        raise BqlError("only finite doubles are stored")
    return struct.pack("<d", x + 0.0)


def decode_i64(data: bytes) -> int:
    if len(data) != 8:
        raise BqlError("a 64-bit integer has 8 bytes")
    return struct.unpack("<q", data)[0]


def decode_f64(data: bytes) -> float:
    if len(data) != 8:
        raise BqlError("a double has 8 bytes")
    return struct.unpack("<d", data)[0]


_D128 = Context(prec=34, Emin=-6143, Emax=6144)


def encode_d128(x: Decimal) -> bytes:
    """The 16 little-endian bytes of a decimal of at most 34 digits: sign, exponent, coefficient."""
    if not x.is_finite():
        raise BqlError("only finite decimals are stored")
    sign, digits, exponent = _D128.create_decimal(x).as_tuple()
    coefficient = int("".join(map(str, digits)))
    return ((sign << 127) | ((exponent + 6176) << 113) | coefficient).to_bytes(16, "little")


def decode_d128(data: bytes) -> Decimal:
    if len(data) != 16:
        raise BqlError("a decimal has 16 bytes")
    n = int.from_bytes(data, "little")
    value = Decimal(n & ((1 << 113) - 1)).scaleb(((n >> 113) & 0x3FFF) - 6176, Context(prec=40, Emin=-9999, Emax=9999))
    return -value if n >> 127 else value


def i64(column: Column) -> Column:
    """8 little-endian bytes as BIGINT; null for other lengths."""
    return F.when(F.octet_length(column) == 8, F.conv(_reversed_hex(column, 8), 16, -10).cast("bigint"))


def _reversed_hex(column: Column, n: int) -> Column:
    text = F.hex(column)
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))])


def i64_bytes(column: Column) -> Column:
    """BIGINT as 8 little-endian bytes."""
    text = F.lpad(F.hex(column), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(8))]))


def wrapped_sum(column: Column) -> Column:
    """The sum of BIGINTs modulo 2 ** 64, as an overflowing addition leaves it, for up to 2 ** 32 of them.

    The halves are summed apart, so that nothing overflows, and put together by shifts.
    """
    low, high = F.sum(column.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(column, 32))
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


# reads


def get(zmap: DataFrame, key: str | bytes) -> DataFrame:
    return zmap.where(F.col("key") == _key(key)).select("value")


def get_i64(zmap: DataFrame, key: str | bytes) -> DataFrame:
    return get(zmap, key).select(i64(F.col("value")).alias("value"))


def get_f64(zmap: DataFrame, key: str | bytes) -> float | None:
    found = get(zmap, key).first()
    return decode_f64(bytes(found[0])) if found else None


def get_d128(zmap: DataFrame, key: str | bytes) -> Decimal | None:
    found = get(zmap, key).first()
    return decode_d128(bytes(found[0])) if found else None


def _from(key: str | bytes, selector: str, first: bool) -> Column:
    """The keys at or past the place that a selector names (first), or before it."""
    if key == OPEN:
        return F.lit(True)
    k, x = F.col("key"), _key(key)
    if selector not in SELECTORS:
        raise BqlError(f"unknown key selector {selector}")
    beyond = selector in ("FIRST_GREATER_THAN",)
    at = k > x if beyond else k >= x
    return at if first else ~at


def get_range(zmap: DataFrame, begin: str | bytes, end: str | bytes, *, limit: int | None = DEFAULT_LIMIT, reverse: bool = False, begin_selector: str = "FIRST_GREATER_OR_EQUAL", end_selector: str = "FIRST_GREATER_THAN") -> DataFrame:
    """Pairs from begin up to the place of the end selector, which by default includes end."""
    low, high = _bound(zmap, begin, begin_selector), _bound(zmap, end, end_selector)
    rows = zmap
    rows = rows if low is None else rows.where(low[0])
    rows = rows if high is None else rows.where(~high[0])
    rows = rows.orderBy(F.col("key").desc() if reverse else F.col("key"))
    return rows if limit is None else rows.limit(limit)


def _bound(zmap: DataFrame, key: str | bytes, selector: str) -> tuple[Column] | None:
    """The condition of lying at or past a selector's place; None for an open end."""
    if key == OPEN:
        return None
    if selector.startswith("FIRST"):
        return (_from(key, selector, True),)
    if selector not in SELECTORS:
        raise BqlError(f"unknown key selector {selector}")
    place = get_key(zmap, key, selector).first()
    return (F.col("key") >= F.lit(bytes(place[0])),) if place and place[0] is not None else (F.lit(True),)


def get_key(zmap: DataFrame, key: str | bytes, selector: str = "FIRST_GREATER_OR_EQUAL") -> DataFrame:
    """The key that a selector resolves to: one row, null where there is none."""
    k, x = F.col("key"), _key(key)
    match selector:
        case "FIRST_GREATER_OR_EQUAL":
            return zmap.where(k >= x).agg(F.min("key").alias("key"))
        case "FIRST_GREATER_THAN":
            return zmap.where(k > x).agg(F.min("key").alias("key"))
        case "LAST_LESS_THAN":
            return zmap.where(k < x).agg(F.max("key").alias("key"))
        case "LAST_LESS_OR_EQUAL":
            return zmap.where(k <= x).agg(F.max("key").alias("key"))
    raise BqlError(f"unknown key selector {selector}")


def range_size(zmap: DataFrame, begin: str | bytes, end: str | bytes) -> DataFrame:
    """Bytes of keys and values in [begin, end), exactly."""
    rows = _between(zmap, begin, end)
    return rows.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).cast("bigint").alias("bytes"))


def _inside(begin: str | bytes, end: str | bytes) -> Column:
    low = F.lit(True) if begin == OPEN else F.col("key") >= _key(begin)
    return low if end == OPEN else low & (F.col("key") < _key(end))


def _between(zmap: DataFrame, begin: str | bytes, end: str | bytes) -> DataFrame:
    return zmap.where(_inside(begin, end))


# writes


def put_all(zmap: DataFrame, pairs: DataFrame) -> DataFrame:
    """zmap with the pairs of another map in place of its own."""
    return zmap.join(pairs.select("key"), "key", "left_anti").select("key", "value").unionByName(pairs.select("key", "value"))


def put(zmap: DataFrame, key: str | bytes, value: str | bytes) -> DataFrame:
    one = zmap.sparkSession.createDataFrame([(bytearray(_bytes(key)), bytearray(_bytes(value)))], DDL)
    return zmap.where(F.col("key") != _key(key)).unionByName(one)


def put_i64(zmap: DataFrame, key: str | bytes, n: int) -> DataFrame:
    return put(zmap, key, encode_i64(n))


def put_f64(zmap: DataFrame, key: str | bytes, x: float) -> DataFrame:
    return put(zmap, key, encode_f64(x))


def put_d128(zmap: DataFrame, key: str | bytes, x: Decimal) -> DataFrame:
    return put(zmap, key, encode_d128(x))


def delete(zmap: DataFrame, key: str | bytes) -> DataFrame:
    return zmap.where(F.col("key") != _key(key))


def delete_range(zmap: DataFrame, begin: str | bytes, end: str | bytes) -> DataFrame:
    """Without the keys of [begin, end)."""
    return zmap.where(~_inside(begin, end))


def increment_i64(zmap: DataFrame, deltas: DataFrame) -> DataFrame:
    """zmap after a batch of increments (key, delta BIGINT); a missing key counts from 0, sums wrap."""
    return mutate(zmap, deltas.select("key", i64_bytes(F.col("delta")).alias("param")), "ADD")


def increment_f64(zmap: DataFrame, key: str | bytes, delta: float) -> DataFrame:
    return put_f64(zmap, key, (get_f64(zmap, key) or 0.0) + delta)


def increment_d128(zmap: DataFrame, key: str | bytes, delta: Decimal) -> DataFrame:
    total = (get_d128(zmap, key) or Decimal(0)) + delta
    if total.adjusted() > 6144:
        raise BqlError("decimal overflow")
    return put_d128(zmap, key, total)


def mutate(zmap: DataFrame, batch: DataFrame, kind: str, versionstamp: bytes | None = None) -> DataFrame:
    """zmap after a batch of mutations (key, param) of one kind, folded by key.

    Bitwise, ADD, MAX and MIN act on 64-bit little-endian integers, MAX and MIN
    as unsigned ones; a map of numbers (value and param BIGINT) needs no coding.
    Where a key is absent, MIN, BIT_AND, BYTE_MIN and BYTE_MAX store the
    parameter as it is.  The order of mutations of one key matters to
    APPEND_IF_FITS and SET_VERSIONSTAMPED_VALUE: it is that of a column ``seq``
    of the batch, then of the parameters.
    """
    if kind not in MUTATIONS:
        raise BqlError(f"unknown mutation {kind}")
    if kind == "COMPARE_AND_CLEAR":
        hits = zmap.join(batch.select("key", F.col("param")), "key").where(F.col("value") == F.col("param")).select("key")
        return zmap.join(hits, "key", "left_anti").select("key", "value")
    seq = F.col("seq") if "seq" in batch.columns else F.lit(0)
    if kind == "SET_VERSIONSTAMPED_VALUE":
        if versionstamp is None or len(versionstamp) != 10:
            raise BqlError("a versionstamp has 10 bytes")
        last = batch.groupBy("key").agg(F.max_by("param", F.struct(seq, "param")).alias("param"))
        stamped = F.concat(F.lit(versionstamp), F.expr("substring(param, 11)"))
        return put_all(zmap, last.select("key", stamped.alias("value")))
    typed = isinstance(zmap.schema["value"].dataType, T.LongType)
    if typed and kind in ("APPEND_IF_FITS", "BYTE_MIN", "BYTE_MAX"):
        raise BqlError(f"{kind} acts on bytes")
    if kind == "APPEND_IF_FITS":
        return _append(zmap, batch.select("key", F.col("param").alias("value"), seq.alias("seq")))
    both = zmap.select("key", "value", F.lit(0).alias("turn")).unionByName(batch.select("key", F.col("param").alias("value"), F.lit(1).alias("turn")))
    number, stored = (F.col("value"), lambda c: c) if typed else (i64(F.col("value")), i64_bytes)
    if kind == "ADD":
        fold = stored(wrapped_sum(number))
    elif kind in ("BIT_AND", "BIT_OR", "BIT_XOR"):
        fold = stored({"BIT_AND": F.bit_and, "BIT_OR": F.bit_or, "BIT_XOR": F.bit_xor}[kind](number))
    elif kind in ("MAX", "MIN"):
        fold = (F.max_by if kind == "MAX" else F.min_by)("value", _unsigned(number))
    else:
        fold = (F.min if kind == "BYTE_MIN" else F.max)("value")
    # One aggregation over both: a key without a mutation keeps its value.
    own = F.max(F.when(F.col("turn") == 0, F.col("value")))
    folded = both.groupBy("key").agg(F.when(F.max("turn") == 1, fold).otherwise(own).alias("value"))
    return folded.where("value IS NOT NULL")


def _append(zmap: DataFrame, pieces: DataFrame) -> DataFrame:
    """zmap with the pieces (key, value, seq) of each key appended in order, those left out that no longer fit.

    What fits depends on all that came before, so a key is one task's; it is streamed in order, and one value is held.
    """
    both = zmap.select(F.lit(0).alias("turn"), "key", "value", F.lit(None).cast(pieces.schema["seq"].dataType).alias("seq")).unionByName(pieces.select(F.lit(1).alias("turn"), "key", "value", "seq"))
    ordered = both.repartition("key").sortWithinPartitions("key", "turn", "seq", "value").select("key", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, bytearray()
        for batch in batches:
            keys, values = [], []
            for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key), values.append(bytes(value))
                    key, value = k, bytearray()
                if v is not None and len(value) + len(v) <= MOST_VALUE:
                    value += v
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "value"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([bytes(value)], pa.binary())], names=["key", "value"])

    return ordered.mapInArrow(run, DDL)


def _unsigned(column: Column) -> Column:
    return column.bitwiseXOR(F.lit(-(1 << 63)))


def watch(changes: DataFrame, key: str | bytes) -> DataFrame:
    """The changes of one key, from a stream or a table of changes with a key column."""
    return changes.where(F.col("key") == _key(key))


def inexact(value: Decimal) -> bool:
    """Whether a decimal needs rounding to be stored."""
    context = Context(prec=34)
    context.create_decimal(value)
    return bool(context.flags[Inexact])


def rows(zmap: DataFrame) -> list[tuple[bytes, bytes]]:
    """All pairs in order, for small maps."""
    return [(bytes(r["key"]), bytes(r["value"])) for r in zmap.orderBy("key").collect()]


def of(spark: Any, pairs: dict) -> DataFrame:
    """A small map."""
    return spark.createDataFrame([(bytearray(_bytes(k)), bytearray(_bytes(v))) for k, v in pairs.items()], DDL)

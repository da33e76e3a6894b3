"""Orders: by the id, by a field with the id as tie-break, by type brackets; and keyset paging."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.functions.collation import Collation
from bramble.functions.paths import Row
from bramble.plans import dynamic
from bramble.plans.bql import BqlError
from bramble.sources.documents import DOCUMENT, is_dynamic


def natural_order(id_col: str = "_id") -> list[Column]:
    return [F.col(id_col).asc()]


def sort_key(df: DataFrame, field: str, collation: Collation | None = None) -> Column:
    if is_dynamic(df) and field not in df.columns:
        return variant_key(dynamic.select(F.col(DOCUMENT), field))
    value = Row(df.schema).at(field)
    if value.kind is None:
        return F.lit(None)
    if collation is not None and value.kind.typeName().startswith("string"):
        return collation.key(value.column)
    return value.column


def sort_order(df: DataFrame, field: str, direction: str = "ASC", id_col: str = "_id", collation: Collation | None = None) -> list[Column]:
    """Ascending with nulls first, or descending with nulls last; the id breaks ties in the same direction."""
    if direction.upper() not in ("ASC", "DESC"):
        raise BqlError("a sort direction is ASC or DESC")
    key = sort_key(df, field, collation)
    if direction.upper() == "ASC":
        return [key.asc_nulls_first(), F.col(id_col).asc()]
    return [key.desc_nulls_last(), F.col(id_col).desc()]


def variant_key(column: Column) -> Column:
    """What orders VARIANT values by type bracket, then by value: null, number, string, document, array, binary, object id, boolean, datetime, timestamp."""
    kind = F.schema_of_variant(column)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    integral = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL)")
    binary, object_id, moment, stamp = dynamic.binary_of(column), dynamic.object_id_of(column), dynamic.datetime_of(column), dynamic.timestamp_of(column)
    rank = (
        F.when(column.isNull() | (kind == "VOID"), 0).when(number, 1).when(kind == "STRING", 2).when(binary.isNotNull(), 5).when(object_id.isNotNull(), 6)
        .when(moment.isNotNull(), 8).when(stamp.isNotNull(), 9).when(kind.startswith("OBJECT"), 3).when(kind.startswith("ARRAY"), 4).when(kind == "BOOLEAN", 7).otherwise(10)
    )
    return F.struct(
        rank.alias("rank"),
        F.when(number, F.try_variant_get(column, "$", "double")).alias("double"),
        # Doubles tie where decimals of 38 digits do not: by whole numbers, then by what follows the point.
        F.when(integral, F.try_variant_get(column, "$", "decimal(38,0)")).alias("whole"),
        F.when(integral, F.try_variant_get(column, "$", "decimal(38,18)")).alias("exact"),
        F.when(kind == "STRING", F.try_variant_get(column, "$", "string")).alias("string"),
        F.when(kind == "BOOLEAN", F.try_variant_get(column, "$", "boolean")).alias("boolean"),
        F.when(rank == 5, binary).alias("binary"),
        F.when(rank == 6, object_id).alias("object_id"),
        F.when(rank == 8, moment).alias("moment"),
        F.when(rank == 9, stamp).alias("timestamp"),
        F.when(rank.isin(3, 4, 10), F.to_json(column)).alias("json"),
    )


@dataclass
class Cursor:
    """A query, its order, and the last row handed out: each page starts strictly after it."""

    rows: DataFrame
    limit: int
    id_col: str = "_id"
    field: str | None = None
    direction: str = "ASC"
    collation: Collation | None = None
    last: tuple[Any, Any] | None = None
    done: bool = False

    def page(self) -> DataFrame:
        """The next page; ``advance`` moves past it."""
        up = self.direction.upper() == "ASC"
        tie = F.col(self.id_col)
        if self.field is None:
            rows = self.rows
            if self.last is not None:
                rows = rows.where(tie > F.lit(self.last[1]))
            return rows.orderBy(tie.asc()).limit(self.limit)
        key = sort_key(self.rows, self.field, self.collation)
        rows = self.rows
        if self.last is not None:
            value, row_id = self.last
            after = tie > F.lit(row_id) if up else tie < F.lit(row_id)
            if value is None:
                rows = rows.where((key.isNull() & after) | (key.isNotNull() if up else F.lit(False)))
            else:
                bound = F.lit(value) if self.collation is None else self.collation.key(F.lit(value))
                beyond = key > bound if up else (key < bound) | key.isNull()
                rows = rows.where(beyond | ((key == bound) & after))
        return rows.orderBy(*sort_order(self.rows, self.field, self.direction, self.id_col, self.collation)).limit(self.limit)

    def advance(self) -> list:
        """The rows of the next page, at most limit of them; empty once exhausted."""
        if self.done:
            return []
        found = self.page().collect()
        if not found:
            self.done = True
            return []
        end = found[-1]
        value = None
        if self.field is not None:
            value = end
            for part in self.field.split("."):
                value = None if value is None else value[part]
        self.last = (value, end[self.id_col])
        return found

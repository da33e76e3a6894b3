"""Documents in and out: JSON, as typed columns or as one VARIANT column, and sorted Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "_doc"


def is_dynamic(rows: DataFrame) -> bool:
    """Whether rows hold schemaless documents."""
    return DOCUMENT in rows.columns and isinstance(rows.schema[DOCUMENT].dataType, T.VariantType)


def from_json(rows: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """rows with a JSON text column as documents: typed columns under a schema, else one VARIANT column."""
    others = [c for c in rows.columns if c != column]
    if schema is None:
        return rows.select(*others, F.try_parse_json(column).alias(DOCUMENT))
    return rows.select(*others, F.from_json(column, schema).alias(DOCUMENT)).select(*others, f"{DOCUMENT}.*")


def to_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text, null fields left out."""
    if rows.columns == [DOCUMENT]:
        return rows.select(F.to_json(DOCUMENT).alias(name))
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(name))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file of one document a line; without a schema it is not inferred but kept as VARIANT."""
    return from_json(spark.read.text(path), "value", schema)


def object_id(column: str):
    """A text column as an object id: small letters, null unless 24 hex digits; tagged for the compiler."""
    value = F.lower(F.col(column))
    return F.when(value.rlike("^[0-9a-f]{24}$"), value).alias(column, metadata={"bson": "objectid"})

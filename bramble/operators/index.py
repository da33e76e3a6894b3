"""Index metadata, the constraints that indexes carry, and their statistics.

Spark has no secondary index; what remains of one is its contract (types,
uniqueness, which orders it gives), a sorted layout on disk, and statistics.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions.collation import Collation
from bramble.functions.paths import Row
from bramble.operators.sort import variant_key
from bramble.operators.vector import DISTANCES
from bramble.plans import dynamic
from bramble.plans.bql import BqlError
from bramble.plans.compiler import bracket
from bramble.sources.documents import DOCUMENT, is_dynamic

#: Which index states a reader, a writer or both may use.
POLICIES = {"READ": {"READY"}, "WRITABLE": {"WAITING", "BUILDING", "READY"}, "READWRITE": {"READY"}, "ALL": {"WAITING", "BUILDING", "READY", "DROPPED"}}
_WIDENS = {"int32": {"byte", "short", "integer"}, "int64": {"byte", "short", "integer", "long"}, "double": {"byte", "short", "integer", "float", "double"}}
_BRACKETS = {"int32": "number", "int64": "number", "double": "number", "string": "string", "boolean": "boolean", "binary": "binary", "datetime": "datetime", "timestamp": "timestamp", "objectid": "objectid"}


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[str, ...]
    types: tuple[str, ...] = ()
    kind: str = "single"  # single, compound, vector or primary
    unique: bool = False
    multi_key: bool = False
    collation: Collation | None = None
    dimensions: int | None = None
    distance: str = "COSINE"
    status: str = "WAITING"
    strict: bool = True

    def ready(self) -> Index:
        return replace(self, status="READY")


def parse_indexes(spec: Mapping[str, Any]) -> list[Index]:
    """Indexes from a schema: a field with its options, ``$compound`` and ``$vector`` lists of them."""
    out = []
    for name, body in spec.items():
        if name == "$compound":
            for one in body if isinstance(body, list) else [body]:
                fields = one["fields"]
                fields = [{"selector": k, **v} for k, v in fields.items()] if isinstance(fields, Mapping) else fields
                paths = tuple(f["selector"] for f in fields)
                if len(paths) < 2 or sum(bool(f.get("multi_key")) for f in fields) > 1:
                    raise BqlError("a compound index has two fields or more, at most one of them multi-key")
                multi = any(f.get("multi_key") for f in fields)
                out.append(_checked(Index(one.get("name", "_".join(paths)), paths, tuple(f["bson_type"] for f in fields), "compound", bool(one.get("unique")), multi, Collation.of(one.get("collation")))))
        elif name == "$vector":
            for one in body if isinstance(body, list) else [body]:
                distance = str(one.get("distance", "COSINE")).upper()
                if distance not in DISTANCES or not isinstance(one.get("dimensions"), int) or one["dimensions"] < 1:
                    raise BqlError("a vector index has dimensions and a distance function")
                field = one.get("field") or one["selector"]
                out.append(Index(one.get("name", f"vector_{field}"), (field,), ("double",), "vector", dimensions=one["dimensions"], distance=distance))
        else:
            kind = body["bson_type"]
            out.append(_checked(Index(body.get("name", name), (name,), (kind,), "single", bool(body.get("unique")), bool(body.get("multi_key")), Collation.of(body.get("collation")))))
    return out


def _checked(index: Index) -> Index:
    if unknown := [t for t in index.types if t not in _BRACKETS]:
        raise BqlError(f"types {unknown} cannot be indexed")
    if index.unique and index.multi_key:
        raise BqlError("a unique index is not multi-key")
    return index


def type_errors(df: DataFrame, index: Index) -> list[str]:
    """Fields whose column cannot be widened to the index's type."""
    out = []
    for field, want in zip(index.fields, index.types, strict=False):
        value = Row(df.schema).at(field)
        kind = value.kind.elementType if index.multi_key and value.is_array or index.kind == "vector" and value.is_array else value.kind
        if kind is None or isinstance(kind, T.NullType):
            continue
        fits = bracket(kind, value.bson) == _BRACKETS[want]
        if fits and want in _WIDENS and index.kind != "vector":
            fits = kind.typeName() in _WIDENS[want]
        if not fits:
            out.append(f"{field}: {kind.simpleString()} is not {want}")
    return out


def _keys(df: DataFrame, index: Index) -> list[Column]:
    """The fields of an index as columns that compare: k0, k1, ...; of a schemaless document by type, then value."""
    out = []
    for i, field in enumerate(index.fields):
        if is_dynamic(df) and field not in df.columns:
            column = variant_key(dynamic.select(F.col(DOCUMENT), field))
        else:
            value = Row(df.schema).at(field)
            column = value.column
            if index.collation is not None and isinstance(value.kind, T.StringType):
                column = index.collation.key(column)
        out.append(column.alias(f"k{i}"))
    return out


def duplicates(df: DataFrame, index: Index) -> DataFrame:
    """The keys that more than one row has; missing counts as a value."""
    keys = _keys(df, index)
    return df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(df: DataFrame, index: Index) -> None:
    if index.unique and not duplicates(df, index).isEmpty():
        raise BqlError(f"duplicate key in unique index {index.name!r}")


def check_added(df: DataFrame, added: DataFrame, index: Index) -> None:
    """Raises if rows to be added repeat a key of a unique index, among themselves or with one of df; df itself is not shuffled for a small batch."""
    if not index.unique:
        return
    check_unique(added, index)
    names = [f"k{i}" for i in range(len(index.fields))]
    old, new = df.select(*_keys(df, index)).alias("o"), added.select(*_keys(added, index)).distinct().alias("n")
    same = reduce(and_, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in names])
    if not old.join(new, same, "left_semi").isEmpty():
        raise BqlError(f"duplicate key in unique index {index.name!r}")


_KINDS = {"int32": "^(INT|SMALLINT|TINYINT|BIGINT)", "int64": "^(INT|SMALLINT|TINYINT|BIGINT)", "double": "^(INT|SMALLINT|TINYINT|BIGINT|DOUBLE|FLOAT|DECIMAL)", "string": "^STRING$", "boolean": "^BOOLEAN$"}


def _fits(value: Column, want: str) -> Column:
    """Whether a VARIANT value can be an entry of an index of a type; null and missing are."""
    kind = dynamic.kind_of(value)
    if want in _KINDS:
        fits = kind.rlike(_KINDS[want])
        if want == "int32":
            fits = fits & F.coalesce(F.try_variant_get(value, "$", "bigint").between(-(1 << 31), (1 << 31) - 1), F.lit(False))
    else:
        read = {"binary": dynamic.binary_of, "datetime": dynamic.datetime_of, "timestamp": dynamic.timestamp_of, "objectid": dynamic.object_id_of}[want]
        fits = read(value).isNotNull()
    return value.isNull() | (kind == "VOID") | F.coalesce(fits, F.lit(False))


def type_violations(df: DataFrame, index: Index) -> DataFrame:
    """The rows of schemaless documents with a value that an index of strict types does not take; elements count one by one."""
    wrong = F.lit(False)
    for field, want in zip(index.fields, index.types, strict=False):
        value = dynamic.select(F.col(DOCUMENT), field)
        elements = F.when(dynamic.kind_of(value).startswith("ARRAY"), value.cast("array<variant>"))
        bad = ~_fits(value, want)
        if index.multi_key or index.kind == "vector":
            bad = F.when(elements.isNotNull(), F.exists(elements, lambda e, want=want: ~_fits(e, want))).otherwise(bad)
        wrong = wrong | bad
    return df.where(wrong)


def entries(df: DataFrame, index: Index, id_col: str = "_id") -> DataFrame:
    """The entries of an index, a column a field and the id; a multi-key field has one for each distinct element."""
    columns = []
    if is_dynamic(df):
        for i, field in enumerate(index.fields):
            value = dynamic.select(F.col(DOCUMENT), field)
            elements = F.when(dynamic.kind_of(value).startswith("ARRAY"), value.cast("array<variant>")).otherwise(F.array(value))
            if index.multi_key:  # distinct by what compares, as VARIANT values do not
                value = F.explode_outer(F.array_distinct(F.transform(elements, variant_key)))
            columns.append((value if index.multi_key else variant_key(value)).alias(f"k{i}"))
        return df.select(*columns, F.col(id_col))
    for i, field in enumerate(index.fields):
        value = Row(df.schema).at(field)
        column = value.column
        if index.multi_key and value.is_array:
            column = F.explode_outer(F.array_distinct(column))
        columns.append(column.alias(f"k{i}"))
    return df.select(*columns, F.col(id_col))


def sorted_layout(df: DataFrame, index: Index, partitions: int | None = None) -> DataFrame:
    """df laid out by the index's fields, so that Parquet statistics prune as a range scan would."""
    keys = _keys(df, replace(index, collation=None))
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def write_bucket(df: DataFrame, path: str, index: Index | None = None, partitions: int | None = None) -> None:
    """df as Parquet, laid out by an index so that scans with its conditions skip row groups."""
    (sorted_layout(df, index, partitions) if index else df).write.mode("overwrite").parquet(path)


def cardinality(df: DataFrame, index: Index) -> int:
    return entries(df, index, df.columns[0]).count()


def histogram(df: DataFrame, field: str, buckets: int = 10) -> DataFrame:
    """At most so many buckets of equally many distinct values: bucket, low, high, distinct_values, percentile.

    Ranks come from a range partitioning and the partitions' counts, so no task
    sees all values; the driver sees one count a partition.
    """
    spark = df.sparkSession
    value = Row(df.schema).at(field)
    column = F.explode(F.array_distinct(value.column)) if value.is_array else value.column
    distinct = df.select(column.alias("v")).where("v IS NOT NULL").distinct()
    ordered = distinct.repartitionByRange("v").sortWithinPartitions("v").select("v", F.monotonically_increasing_id().alias("at")).persist()
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, before = 0, []
    for p, n in counts:
        before.append((p, total))
        total += n
    if not total:
        return spark.createDataFrame([], f"bucket int, low {value.kind.simpleString() if value.kind else 'string'}, high {value.kind.simpleString() if value.kind else 'string'}, distinct_values long, percentile double")
    offsets = F.broadcast(spark.createDataFrame(before, "p long, before long"))
    rank = F.col("before") + place
    size, more = divmod(total, buckets)
    cut = more * (size + 1)
    tile = F.when(rank < cut, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - cut) / max(size, 1)))
    ranked = ordered.withColumn("p", part).join(offsets, "p").withColumn("bucket", (tile + 1).cast("int"))
    out = ranked.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("distinct_values"))
    out = out.withColumn("percentile", F.col("bucket") / F.lit(float(min(buckets, total))))
    done = spark.createDataFrame(out.collect(), out.schema)  # at most so many rows as buckets
    ordered.unpersist()
    return done


#: One value in so many is a hint, by a hash of the row's id.
HINT_MASK = 0x3FFF


def sample_hints(df: DataFrame, field: str, id_col: str = "_id", mask: int = HINT_MASK) -> DataFrame:
    """A sample of a field's values: v of the rows whose id hashes to 0 under mask; it grows with the bucket."""
    value = Row(df.schema).at(field)
    rows = df.where(F.xxhash64(id_col).bitwiseAND(F.lit(mask)) == 0)
    return rows.select((F.explode(F.array_distinct(value.column)) if value.is_array else value.column).alias("v")).where("v IS NOT NULL")


def sampled_histogram(df: DataFrame, field: str, buckets: int = 10, id_col: str = "_id", mask: int = HINT_MASK) -> DataFrame:
    """As histogram, from the hints: one scan, and a shuffle of the sample alone."""
    return histogram(sample_hints(df, field, id_col, mask).withColumnRenamed("v", field), field, buckets)

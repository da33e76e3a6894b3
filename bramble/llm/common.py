"""What the operators of this subpackage share: inputs, shared storage, lineage cuts."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble import storage
from bramble.storage import scratch  # noqa: F401

#: The white space of every contract here, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of one Arrow batch on its way to or from Python; both sides hold copies of it.
ARROW_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session deals small Arrow batches from here on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder; lost executors then cost a read, not a recomputation."""
    return storage.materialize(bounded(df))


def stable(df: DataFrame) -> DataFrame:
    """df, stored first where a lost task could get its rows in another order, as behind a shuffle."""
    plan = bounded(df)._jdf.queryExecution().sparkPlan().toString()
    return materialize(df) if "Exchange" in plan or "Join" in plan or "Aggregate" in plan or "Window" in plan else df


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that nothing refers to any longer."""
    for _ in range(2):  # what refers to a shuffle goes in the first round, the shuffle in the second
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _plain(kind: T.DataType) -> bool:
    """Whether values of a type can be hashed."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def keep_rows(docs: DataFrame, decisions: DataFrame, mark: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """The rows of docs that decisions keep, in the columns of docs.

    decisions has a row for each row of docs: doc_id, kept, and the columns of
    ``mark``, which computes them for rows of docs from their contents alone.  A
    row with an id of its own is kept by its id.  Rows that share an id, and rows
    without one, are told apart by the marks; of rows alike in id and marks, of
    which one is kept, it is that with the smallest hash of all its columns.
    """
    id_ = F.col(f"`{key}`")
    ids = materialize(decisions.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept")).where("kept"))
    alone = ids.where("doc_id IS NOT NULL AND rows = 1").select(F.col("doc_id").alias(key))
    kept = docs.join(alone, key, "left_semi").select(*docs.columns)
    shared = ids.where("doc_id IS NULL OR rows > 1")
    if shared.isEmpty():
        return kept
    repeated = docs.join(shared.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(key)), key, "left_semi").select(*docs.columns)
    marked = mark(repeated.unionByName(docs.where(id_.isNull())))
    marks = [c for c in marked.columns if c not in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if _plain(f.dataType)]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias("row")
    one = marked.groupBy(id_.cast("long").alias("kept_id"), *marks).agg(row)  # pre-aggregated: repeated rows never meet in one task
    chosen = decisions.where("kept").select(F.col("doc_id").alias("kept_id"), *marks).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("kept_id", *marks)]
    odd = one.alias("a").join(chosen.alias("b"), reduce(and_, same), "left_semi").select("row.*")
    return kept.unionByName(odd)

"""Change logs: ranges, watches, replication and offsets, batch and streaming.

A change has seq, op (SET or DELETE), key and value.  Replication is a backfill
followed by micro-batches, each folded to one change a key before it is applied;
sequence numbers make a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.plans.bql import BqlError

DDL = "seq bigint, op string, key binary, value binary"
DEFAULT_LIMIT = 1000


def changes_between(changes: DataFrame, begin: int | None = None, end: int | None = None, *, begin_inclusive: bool = True, end_inclusive: bool = False, reverse: bool = False, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Changes by sequence number between two bounds, open where None."""
    seq = F.col("seq")
    if begin is not None:
        changes = changes.where(seq >= begin if begin_inclusive else seq > begin)
    if end is not None:
        changes = changes.where(seq <= end if end_inclusive else seq < end)
    ordered = changes.orderBy(seq.desc() if reverse else seq)
    return ordered if limit is None else ordered.limit(limit)


def folded(changes: DataFrame) -> DataFrame:
    """The last change of each key."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("c"))
    return last.select(F.col("c.seq").alias("seq"), F.col("c.op").alias("op"), "key", F.col("c.value").alias("value"))


def replay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A map (key, value) after its changes."""
    last = folded(changes)
    kept = base.join(last.select("key"), "key", "left_anti").select("key", "value")
    return kept.unionByName(last.where("op = 'SET'").select("key", "value"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of changes that appear below path."""
    return spark.readStream.schema(DDL).parquet(path)


def watch(changes: DataFrame, key: bytes) -> DataFrame:
    """The changes of one key, of a stream or a table."""
    return changes.where(F.col("key") == F.lit(key))


def replicate(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Feeds each micro-batch, folded, to apply; the checkpoint keeps what has been read."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: apply(folded(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Consumer:
    """Reads a journal (a table with seq) in order from an offset: EARLIEST, LATEST or RESUME.

    The offset is published as a table of one row for each commit; the largest counts.
    """

    def __init__(self, spark: SparkSession, journal: Callable[[], DataFrame], offsets: str, start: str = "RESUME") -> None:
        if start not in ("EARLIEST", "LATEST", "RESUME"):
            raise BqlError(f"unknown offset {start}")
        self.spark, self.journal, self.offsets = spark, journal, offsets
        stored = self._stored() if start == "RESUME" else None
        if stored is not None:
            self.offset = stored
        elif start == "LATEST":
            self.offset = journal().agg(F.max("seq")).first()[0] or 0
        else:
            self.offset = -1

    def _stored(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.offsets)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self.offsets).agg(F.max("seq")).first()[0]

    def poll(self, limit: int = DEFAULT_LIMIT) -> list:
        """The next entries, at most limit of them; the offset moves past them."""
        found = changes_between(self.journal(), self.offset, begin_inclusive=False, limit=limit).collect()
        if found:
            self.offset = found[-1]["seq"]
        return found

    def commit(self) -> None:
        self.spark.createDataFrame([(self.offset,)], "seq bigint").write.mode("append").parquet(self.offsets)

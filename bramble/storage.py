"""Where intermediate tables are kept: the folder in spark.checkpoint.dir, shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """That folder; a local session without executors of its own may do without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = named or tempfile.mkdtemp(prefix="bramble-")
        spark.sparkContext.setCheckpointDir(own)
    return named or own


def materialize(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage; a lost executor costs a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

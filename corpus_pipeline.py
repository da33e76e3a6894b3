"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns documents in the columns of
documents; the last adds ``copies``, how often the mix takes a document.  Stages
decide on rows: distinct texts under one id stay, copies without an id go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bramble.llm import language
from bramble.llm.common import remove, scratch, table
from bramble.llm.decontaminate import decontaminate
from bramble.llm.exact_dedup import drop_exact_duplicates
from bramble.llm.mixing import apply_mix
from bramble.llm.set_join import drop_near_duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language by the hierarchical model: what has no letter, or is not recognised, goes."""
    return language.reject_unknown(docs, language.fit_language_model(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return drop_exact_duplicates(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of sets of five-word shingles at a similarity of 0.8."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    return apply_mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
]
#: SQL expresses neither the learned languages, the alignment nor the mix; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written and read again, then the one before it removed."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            remove(spark, last)
        last = path
    return docs

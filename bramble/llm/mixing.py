"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length.  A source whose target
exceeds its size is taken whole as often as it fits; what remains of the budget
is shared over the lengths in proportion, and a bounded-knapsack dynamic program
over the left-over counts fits its last part.  From each length the documents
with the smallest seeded hashes (draws) are selected, as many as the plan says:
two histograms of 64 buckets, one within a bucket of the other, and the distinct
draws of the last bucket find the draw up to which documents are taken, so no
source, length or group of copies is gathered in one task.  Whether a document
is taken then follows from its own row and the plan.

What the driver and the closure hold is one row a source.  A source of S words
has at most sqrt(2 S) different lengths, which bounds the knapsack's group.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take nothing; rows without an id draw by
their text; rows that share an id, or a draw, are documents of their own, and
where the plan takes some of them only, they are interchangeable; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bramble.llm.common import WORD, materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: No source or document is taken more often than this.
MOST_REPEATS = 3
#: The dynamic program fits an eighth of what is left of a source's budget, and no more words than this.
PROGRAM_WORDS = 1 << 16
#: Bits of a draw, and of a histogram's buckets.
DRAW_BITS, BUCKET_BITS = 48, 6
#: Rows of a plan that are broadcast at most; beyond them it is joined by a shuffle.
BROADCAST_ROWS = 1 << 17
_PLACE = ["__no_source", "__source", "__size"]


def fill_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = MOST_REPEATS) -> list[float]:
    """Shares the sum of sizes by weight; what exceeds cap times a size goes to the others by weight."""
    total = float(sum(sizes))
    targets = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = total
    while open_:
        scale = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * scale > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * scale
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def bounded_knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take, at most counts, for the largest sum up to budget; memory is that of the budget."""
    taken = [0] * len(lengths)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    last = np.zeros(budget + 1, np.int32)  # the first item with which a sum is reached
    items: list[tuple[int, int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, piece = min(count, budget // length), 1
        while count > 0 and not reach[budget]:
            part = min(piece, count)
            weight = length * part
            new = reach[: budget + 1 - weight] & ~reach[weight:]
            last[weight:][new] = len(items)
            reach[weight:] |= new
            items.append((weight, i, part))
            count, piece = count - part, piece * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        weight, i, part = items[last[at]]
        taken[i] += part
        at -= weight
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(times that every document is taken, how many of each length are taken once more)."""
    size = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if size == 0:
        return 0, extra
    whole = min(int(target // size), MOST_REPEATS)
    rest = 0 if whole == MOST_REPEATS else int(round(target - whole * size))
    share = rest - min(PROGRAM_WORDS, rest // 8)
    held = took = 0
    for i in np.argsort(-lengths, kind="stable"):
        length, count = int(lengths[i]), int(counts[i])
        if length:
            held += count * length
            extra[i] = more = min(count, (held * share // size - took) // length)  # what a length falls short of goes to the shorter ones
            took += int(more) * length
    order = [int(i) for i in np.argsort(lengths, kind="stable") if lengths[i] > 0 and counts[i] > extra[i]]
    for i, more in zip(order, bounded_knapsack([int(lengths[i]) for i in order], [int(counts[i] - extra[i]) for i in order], max(rest - took, 0)), strict=True):
        extra[i] += more
    return whole, extra


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with what decides about a row: its source, size and draw, from its contents alone."""
    key, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    draw = F.when(key.isNotNull(), F.xxhash64(key, F.lit(seed))).otherwise(F.xxhash64(text, F.lit(seed + 1)))
    return docs.withColumns({
        "__no_source": source.isNull(), "__source": F.coalesce(source, F.lit("")), "__size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        "__draw": F.shiftrightunsigned(draw, 64 - DRAW_BITS),
    })


def _cut(counted: DataFrame, by: list[str], name: str) -> DataFrame:
    """For each group of counts (by, name, held, rest), the value of name at the rest-th row in order: by, name, held there, rest within."""
    before = F.sum("held").over(Window.partitionBy(*by).orderBy(name)) - F.col("held")
    found = counted.withColumn("before", before).where("before < rest AND before + held >= rest")
    return found.select(*by, name, "held", (F.col("rest") - F.col("before")).alias("rest"))


def _plan(slim: DataFrame, weights: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(plan by source and size: whole, cut, ties, quota; sizes and targets of the sources)."""
    spark, by = slim.sparkSession, _PLACE
    sizes = {(r[0], r[1]): r[2] for r in slim.groupBy(*by[:2]).agg(F.sum("__size")).collect()}  # one row a source
    order = sorted(sizes)  # code points, null last
    targets = dict(zip(order, fill_targets([sizes[k] for k in order], [weights[i % len(weights)] for i in range(len(order))]), strict=True))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole, extra = fit_lengths(rows["__size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), targets[bool(key[0]), key[1]])
        return rows.assign(whole=whole, extra=extra)

    lengths = slim.groupBy(*by).agg(F.count("*").alias("n"))
    plan = materialize(lengths.groupBy(*by[:2]).applyInPandas(fit, "__no_source boolean, __source string, __size long, n long, whole int, extra long"))

    draw, low = F.col("__draw"), DRAW_BITS - BUCKET_BITS
    high = F.shiftright(draw, low)
    next_ = F.shiftright(draw, low - BUCKET_BITS).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    some = plan.where("extra > 0 AND extra < n").select(*by, F.col("extra").alias("rest"))
    # Rows are counted by bucket before they meet the plan, so that a hot source and length is spread over its buckets.
    histogram = materialize(slim.groupBy(*by, high.alias("high"), next_.alias("next")).agg(F.count("*").alias("held")))
    first = _cut(histogram.groupBy(*by, "high").agg(F.sum("held").alias("held")).join(some, by), by, "high")
    second = _cut(histogram.join(first.drop("held"), [*by, "high"]), [*by, "high"], "next")
    last = slim.withColumns({"high": high, "next": next_}).join(second.drop("held"), [*by, "high", "next"])
    cuts = _cut(last.groupBy(*by, "rest", draw.alias("cut")).agg(F.count("*").alias("held")), by, "cut")
    every = F.when(F.col("extra") >= F.col("n"), F.lit(1 << DRAW_BITS)).otherwise(F.lit(-1))
    plan = plan.join(cuts, by, "left").select(*by, "whole", F.coalesce("cut", every).alias("cut"), F.coalesce("held", F.lit(0)).alias("ties"), F.coalesce("rest", F.lit(0)).alias("quota"))
    totals = spark.createDataFrame([(*k, sizes[k], targets[k]) for k in order], "__no_source boolean, __source string, source_size long, target double")
    return materialize(plan), totals


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (placed) with ``__copies``."""
    columns = rows.columns
    size, tied = plan.agg(F.count("*"), F.count_if(F.col("quota") < F.col("ties"))).first()
    joined = rows.join(F.broadcast(plan) if size <= BROADCAST_ROWS else plan, _PLACE)
    split = (F.col("__draw") == F.col("cut")) & (F.col("quota") < F.col("ties"))
    out = joined.where(~split).select(*columns, (F.col("whole") + (F.col("__draw") <= F.col("cut")).cast("int")).alias("__copies"))
    if not tied:
        return out
    # Documents of one draw, some of which are taken: the first ones by stored partition, and by place within it.
    tied = materialize(joined.where(split)).withColumn("__part", F.spark_partition_id())
    counts = tied.groupBy(*_PLACE, "__part").agg(F.count("*").alias("held"))
    before = counts.select(*_PLACE, "__part", (F.sum("held").over(Window.partitionBy(*_PLACE).orderBy("__part")) - F.col("held")).alias("before"))
    place = F.row_number().over(Window.partitionBy(*_PLACE, "__part").orderBy(F.lit(1)))
    ranked = tied.join(before, [*_PLACE, "__part"]).withColumn("__place", place + F.col("before"))
    return out.unionByName(ranked.select(*columns, (F.col("whole") + (F.col("__place") <= F.col("quota")).cast("int")).alias("__copies")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, seed: int = 11) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies."""
    placed = _placed(docs.select(*{id_col: 0, text_col: 0, source_col: 0}), id_col, text_col, source_col, seed)
    slim = materialize(placed.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *_PLACE, "__draw"))
    plan, totals = _plan(slim, weights)
    copies = _with_copies(slim, plan).join(totals, _PLACE[:2])
    source, size = F.when(~F.col("__no_source"), F.col("__source")), F.col("__size")
    return copies.select("doc_id", source.alias("source"), size.alias("size"), "source_size", "target", (size * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, seed: int = 11) -> DataFrame:
    """docs that the mix takes, with how often: its columns and ``copies``, which replaces a column of that name.

    Every row is decided on by itself, so the mix meets its targets on rows that share an id, or have none, as well.
    """
    docs = docs.drop("copies")
    placed = _placed(docs, id_col, text_col, source_col, seed)
    plan, _ = _plan(materialize(placed.select(*_PLACE, "__draw")), weights)
    return _with_copies(placed, plan).where("__copies > 0").select(*docs.columns, F.col("__copies").alias("copies"))

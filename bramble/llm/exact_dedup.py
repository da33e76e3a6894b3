"""Exact duplicates by a distributed content sort.

Sampled splitters range-partition the rows by their normalised bytes, each
partition is sorted externally so that equal texts stand side by side, and each
row is compared in full with its neighbour.  The order is that of the whole
normalised bytes, then of the original's code points (most first), the id and
the row's place in the input; the first row of a group is therefore the one that
stays.  A splitter is cut to the shortest bytes that part its sample from the
one before, so what the driver holds is short.  Only where one text fills more
than a partition, as in a group of copies that holds a third of all rows, does a
splitter carry that text whole, with a place within the group.  The rows on
either side of such a cut are compared in full with the splitter's text, and the
group is put together from one row a partition.

Defined results: a null text is the empty text; texts of white space only are
equal to it.  A null id orders after all others.  Repeated rows belong to one
group; only one row of a group has ``kept``.  An empty table gives an empty
result.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import SPACE, keep_rows, materialize, shuffle_partitions, stable
from bramble.llm.words import SPACES, chunks, string_buffers

#: Sampled rows for each partition.
SAMPLES = 24
_KEY_DDL = "part int, doc_id long, points long, place long, norm binary"
_RUN_DDL = "doc_id long, points long, keep_id long, group_size long, kept boolean, text_sha256 string, part int, cut int"


def _normalised(column: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first row, texts without white space, code points of the originals) by chunks."""
    body, at = string_buffers(column)
    for a, b in chunks(at):
        lo = int(at[a])
        text, cut = body[lo : at[b]], at[a : b + 1] - lo
        keep = ~SPACES[text]
        kept = text[keep].tobytes()
        ends = np.concatenate(([0], np.cumsum(keep)))[cut].tolist()
        points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))[cut]
        yield a, [kept[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], np.diff(points)


def _keyed(splitters: Broadcast | None):
    """Rows with their normalised bytes, their place in the input, and the partition that splitters assign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value if splitters is not None else []
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, texts, points in _normalised(batch.column("text")):
                ids = batch.column("doc_id").slice(a, len(texts))
                places = range(place, place + len(texts))
                place += len(texts)
                rows = zip(texts, points.tolist(), ids.to_pylist(), places, strict=True)
                part = [bisect_right(cuts, (text, -n, i is None, i or 0, at)) for text, n, i, at in rows]
                columns = [pa.array(part, pa.int32()), ids, pa.array(points, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _KEY_DDL.split(", ")])

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("norm", F.desc("points"), F.asc_nulls_last("doc_id"), "place")


def _chosen(step: int):
    """Every step-th of the sorted samples as a splitter; within the copies of one text, whole and with its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, before, last = 0, b"", None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                norm = row["norm"]
                if seen and seen % step == 0:
                    if norm != before:
                        same = next((i for i, (x, y) in enumerate(zip(before, norm, strict=False)) if x != y), len(before))
                        rows.append(row | {"norm": norm[: same + 1], "inner": False})
                    else:
                        rows.append(row | {"inner": norm == last})  # the first one is the border before all copies
                        last = norm
                seen, before = seen + 1, norm
            kinds = {"norm": pa.binary(), "points": pa.int64(), "doc_id": pa.int64(), "place": pa.int64(), "inner": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    return run


def _splitters(rows: DataFrame, partitions: int) -> list[tuple]:
    """Fewer than partitions borders in order: (norm,), before all texts that begin so, or the place of a row among its copies."""
    count = rows.count()
    if partitions < 2 or not count:
        return []
    sample = rows.sample(min(1.0, SAMPLES * partitions / count), seed=7).mapInArrow(_keyed(None), _KEY_DDL)
    step = max(1, min(count, SAMPLES * partitions) // partitions)
    picked = _ordered(sample.repartition(1)).mapInArrow(_chosen(step), "norm binary, points long, doc_id long, place long, inner boolean")
    borders = {(bytes(r["norm"]), -r["points"], r["doc_id"] is None, r["doc_id"] or 0, r["place"]) if r["inner"] else (bytes(r["norm"]),) for r in picked.collect()}
    return sorted(borders)


def _runs(splitters: Broadcast):
    """Groups equal neighbours of one sorted partition; of the open run, ids and code points wait for its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value
        held: list[tuple[pa.Array, pa.Array]] = []  # ids and code points of the open run
        text, part = None, 0

        def cut_of(text: bytes) -> int:
            """Which text's copies go on in a neighbouring partition; -1 where they do not."""
            for border in cuts[max(part - 1, 0) : part + 1]:
                if len(border) > 1 and border[0] == text:
                    return bisect_left(cuts, (text,))
            return -1

        def batch_of(ids: pa.Array, points: pa.Array, starts: np.ndarray, texts: list[bytes], sizes: np.ndarray, keep: pa.Array, kept: np.ndarray) -> pa.RecordBatch:
            """Rows of runs that begin at starts; each row gets its run's size, first id, digest and cut."""
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
            cut = np.array([cut_of(t) for t in texts], np.int32)
            columns = [ids, points, keep.take(pa.array(owner)), pa.array(sizes[owner], pa.int64()), pa.array(kept), digests.take(pa.array(owner)), pa.array(np.full(len(ids), part, np.int32)), pa.array(cut[owner])]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RUN_DDL.split(", ")])

        def closed() -> Iterator[pa.RecordBatch]:
            """The rows of the open run."""
            size, keep = np.array([sum(len(ids) for ids, _ in held)]), held[0][0][:1]
            for i, (ids, points) in enumerate(held):
                kept = np.zeros(len(ids), bool)
                kept[0] = i == 0
                yield batch_of(ids, points, np.zeros(1, np.int64), [text], size, keep, kept)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            norm, ids, points = batch.column("norm"), batch.column("doc_id"), batch.column("points")
            new = np.ones(batch.num_rows, bool)
            new[0] = text is None or norm[0].as_py() != text
            new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            first, last = (int(starts[0]), int(starts[-1])) if len(starts) else (batch.num_rows,) * 2
            if first:
                held.append((ids.slice(0, first), points.slice(0, first)))
            if not len(starts):
                continue
            if held:
                yield from closed()
            if last > first:
                at = starts[:-1] - first
                kept = np.zeros(last - first, bool)
                kept[at] = True
                inner = ids.slice(first, last - first)
                yield batch_of(inner, points.slice(first, last - first), at, norm.take(pa.array(starts[:-1])).to_pylist(), np.diff(starts), inner.take(pa.array(at)), kept)
            held, text = [(ids.slice(last), points.slice(last))], norm[last].as_py()
        if held:
            yield from closed()

    return run


def _code_points(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit(""))).cast("long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, points, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space.  The row with the
    most code points in the original text stays, then the smallest id.
    """
    context = docs.sparkSession.sparkContext
    rows = stable(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    cuts = context.broadcast(_splitters(rows, shuffle_partitions(docs.sparkSession)))
    split = rows.mapInArrow(_keyed(cuts), _KEY_DDL).repartitionById(len(cuts.value) + 1, "part")
    runs = materialize(_ordered(split).select("part", "doc_id", "points", "norm").mapInArrow(_runs(cuts), _RUN_DDL))
    columns = ["doc_id", "points", "keep_id", "group_size", "kept", "text_sha256"]
    pieces = runs.where("cut >= 0 AND kept").groupBy("cut").agg(F.min_by("keep_id", "part").alias("whole_id"), F.sum("group_size").alias("whole_size"), F.min("part").alias("first"))
    if pieces.isEmpty():
        return runs.select(*columns)
    whole = runs.join(F.broadcast(pieces), "cut", "left")  # fewer rows than there are partitions
    inner = F.col("first").isNotNull()
    return whole.withColumns({
        "keep_id": F.when(inner, F.col("whole_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("whole_size", "group_size"), "kept": F.col("kept") & F.coalesce(F.col("part") == F.col("first"), F.lit(True)),
    }).select(*columns)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its duplicates, in the same columns; also among rows that share an id, or have none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def mark(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"__points": _code_points(text), "__sha256": F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256)})

    found = exact_duplicates(docs, id_col, text_col)
    return keep_rows(docs, found.select("doc_id", "kept", F.col("points").alias("__points"), F.col("text_sha256").alias("__sha256")), mark, id_col)

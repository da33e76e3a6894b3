"""Spans of texts: their joined form, its digest, and the map over an Arrow column that finds them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts turned into Python strings at once.
SLICE_ROWS = 256
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def joined(spans: Sequence[tuple], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then by place of the kind in kinds, joined by commas."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in sorted(spans, key=lambda s: (s[1], place[s[0]], s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def find_spans(docs: DataFrame, find: Callable[[pa.Array], list[list[tuple]]], id_col: str, text_col: str) -> DataFrame:
    """doc_id and spans of each row; find takes an Arrow slice of whole texts without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans] for spans in find(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, SPAN_TYPE)], names=["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPAN_DDL}")


def digest_columns(found: DataFrame, base: Sequence[str], kinds: Sequence[str], scores: bool = False) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans as text; with the spans' scores in hundredths, and whether there is any span, if asked."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(text(F.filter(order, lambda s: s["kind"].isin(list(base)))).cast("binary"), 256).alias("base_sha256"),
        text(order).alias("spans"),
        *([F.array_join(F.transform(order, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"), (F.size("spans") > 0).alias("personal")] if scores else []),
    )

"""WARC archives: one request, response or revisit, and metadata record a capture, and their assembly.

``write_archives`` writes plain WARC/1.1 records, gzipped by file, with Spark's
own text writer: the record separator is its line separator.  ``read_records``
streams archives record by record: Spark's text reader splits them where a
record may begin, and Content-Length says how many pieces make one up, so a
payload may hold the separator.  ``assemble`` joins the records of a capture
through WARC-Concurrent-To (a request or metadata record names its response, a
response or revisit stands for itself) and emits one nested row a capture.

Payloads that repeat are written once: of the captures with one payload, the one
with the largest page id is the response and the others revisit it, naming it in
WARC-Refers-To and WARC-Refers-To-Target-URI.  The groups are counted on digests
with partial aggregation, and the join of pages to the repeated digests is one
that adaptive execution can split.

Memory holds one record at a time; a file has about FILE_BYTES of payload.  A
gzipped file is one task's; an archive that is not gzipped must be no larger
than a partition, as records that span two are not put together.

Defined results: a null html is the empty payload; a null url is empty, line
breaks in it are percent-encoded; a row with a null page id is always a
response, and so is each of the repeated rows of the largest id, of which one is
referred to; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bramble.llm.common import materialize

END = "\r\n\r\n"
#: What a record begins with, and where the reader splits an archive.
BEGIN = b"WARC/1."
#: Blocks in one batch of the reader's result.
BATCH_BYTES = 8 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload of a file before compression, about, and captures at most.
FILE_BYTES, FILE_CAPTURES = 64 << 20, 10_000
#: Copies of the record that many revisits refer to, so that no join key is hot.
SALTS = 16
_VERSION = re.compile(rb"[0-9]+\r\n")
RECORD_DDL = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload binary, fields map<string,string>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32, without Python: five hex digits are four letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: Column, record_id: Column, uri: Column, content_type: str, block: Column, more: list[Column]) -> Column:
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri]
    return F.concat(*head, *more, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Writes a capture of each page to path; payloads of least_bytes or more that repeat are revisits."""
    uri = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), "\n", "%0A").alias("uri"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"),
    ).withColumn("bytes", F.octet_length("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary")))
    large = rows.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    counted = large.groupBy("digest", "page_id").agg(F.count("*").alias("copies"), F.min("uri").alias("uri"))
    repeated = counted.groupBy("digest").agg(F.max(F.struct("page_id", "copies", "uri")).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    repeated = materialize(repeated.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.copies").alias("copies"), F.col("first.uri").alias("first_uri")))
    total, count = rows.agg(F.sum("bytes"), F.count("*")).first()
    per_file = max(1, min(FILE_CAPTURES, FILE_BYTES * count // max(total or 0, 1)))

    joined = rows.join(repeated, "digest", "left")
    is_first = (F.col("bytes") >= least_bytes) & F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    joined = joined.withColumn("revisit", (F.col("bytes") >= least_bytes) & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False)))
    if repeated.where("copies > 1").isEmpty():
        joined = joined.withColumn("referred", is_first)
    else:  # rows repeat the largest id: one of them is referred to
        place = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("uri"))
        joined = joined.withColumn("referred", is_first & (place == 1))

    new_id = lambda: F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    target = F.regexp_replace(F.md5(F.concat_ws(":", "digest", "first_id")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    joined = joined.withColumn("target", target).withColumn("capture", F.when(F.col("referred"), F.col("target")).otherwise(new_id()))
    joined = joined.withColumn("request_id", new_id()).withColumn("metadata_id", new_id())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    with_capture = [F.lit("\r\nWARC-Concurrent-To: "), F.col("capture")]
    request = _record(F.lit("request"), F.col("request_id"), F.col("uri"), "application/http;msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{END}")), with_capture)
    refers = F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), F.col("target"), F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("first_uri"))
    digest = [F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.when(F.col("revisit"), refers).otherwise(F.lit(""))]
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    response = _record(kind, F.col("capture"), F.col("uri"), "application/http;msgtype=response", F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))), digest)
    said = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), F.col("metadata_id"), F.col("uri"), "application/warc-fields", said, with_capture)
    text = joined.select(F.concat_ws(END, request, response, metadata).alias("value"))
    text.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive that was split at every BEGIN; pieces of a block are put together again."""
    held = bytearray()
    need, headers, border = None, {}, 0
    for piece in pieces:
        if not held and not _VERSION.match(piece):
            continue  # what precedes the first record
        held += BEGIN + piece
        if need is None and (border := held.find(b"\r\n\r\n")) >= 0:
            headers = {}
            for line in bytes(held[:border]).decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            need = border + 4 + int(headers["content-length"])
        if need is not None and len(held) >= need:
            yield headers, bytes(held[border + 4 : need])
            held, need = bytearray(), None
    if held:
        raise ValueError("an archive ends within a record")


def _fields(block: bytes) -> list[tuple[str, str]]:
    lines = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x)
    return [(name.strip(), value.strip()) for name, _, value in lines]


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives below path: RECORD_DDL.  digest is the payload's own where it is there."""

    kinds = [*[pa.string()] * 6, pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [c.split()[0] for c in RECORD_DDL.replace(",string>", ">").split(", ")]

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind = head.get("warc-type", "")
        digest, size, payload, fields = head.get("warc-payload-digest", "").removeprefix("sha1:"), None, None, []
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest, payload = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), body if with_payload else None
            else:
                size = int(dict(_fields(http)).get("Content-Length", 0))
        elif kind == "metadata":
            fields = _fields(block)
        return head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest or None, size, payload, fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, p) for batch in batches for f, p in zip(batch.column("file"), batch.column("piece"), strict=True))
        rows, held = [], 0
        for _, part in groupby(pieces, key=lambda x: x[0].as_py()):
            for head, block in parse_records(p.as_py() for _, p in part):
                rows.append(row(head, block))
                held += len(block)
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    pieces = spark.read.option("lineSep", BEGIN.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture, request, response, metadata; response is null where there is none."""
    part = F.struct("record_id", "type", "refers_to", "uri", "digest", "payload_bytes", "payload", "fields")
    one = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), part), ignorenulls=True)
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata")
    )


def resolve_revisits(captures: DataFrame, key: str) -> DataFrame:
    """captures (with ``response``) and refers_to, the key of the capture that a revisit's WARC-Refers-To names.

    Only records that are referred to are joined, and each in SALTS copies: half of all captures may revisit one.
    """
    salt = F.pmod(F.xxhash64("response.record_id"), F.lit(SALTS)).cast("int")
    wanted = captures.select(F.col("response.refers_to").alias("__target")).where("__target IS NOT NULL").distinct()
    targets = captures.select(F.col("response.record_id").alias("__target"), F.col(key).alias("refers_to")).join(wanted, "__target")
    targets = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = F.concat(F.lit("-"), F.coalesce("response.record_id", F.lit("")))  # dealt evenly, and no record's id
    marked = captures.withColumn("__target", F.coalesce("response.refers_to", none)).withColumn("__salt", salt)
    return marked.join(targets, ["__target", "__salt"], "left").drop("__target", "__salt")

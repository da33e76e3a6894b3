"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import materialize, remove, scratch, table
from bramble.llm.exact_dedup import exact_duplicates
from bramble.llm import chat, decontaminate, language, mixing, pii, secret_scan, toxicity, warc
from bramble.llm.set_join import set_similarity_components
from bramble.llm.spans import digest_columns


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_similarity_components(table(spark, sf_dir, "documents"), words=4, least=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams FROM w
), g AS (
  SELECT doc_id, unnest(grams) AS gram FROM s
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * common >= 85 * (len(a.grams) + len(b.grams) - common)
), r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY ALL
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return digest_columns(found, [r.kind for r in secret_scan.BASE_RULES], [r.kind for r in secret_scan.RULES])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=False))
    number = F.nullif(F.try_element_at("metadata.fields", F.lit("page-id")), F.lit("")).cast("long")
    slim = materialize(captures.select(number.alias("page_id"), "response"))
    remove(spark, path)
    return warc.resolve_revisits(slim, "page_id").select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to",
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), h AS (
  SELECT page_id, payload, first_id, page_id IS NOT NULL AND page_id <> first_id AS revisit, sha1(payload) AS hex FROM p
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first_id END AS refers_to
FROM h
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.BASE_KINDS, pii.KINDS, scores=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.fit_language_model(docs, floors=False))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    path = scratch(spark, "chat")
    chat.format_conversations(turns).write.parquet(path)
    read = materialize(chat.read_back(spark.read.parquet(path)))
    remove(spark, path)
    return read


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_warc": OP6_SQL,
}

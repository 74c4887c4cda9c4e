"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteratio.llm import (
    archive,
    bytepairs,
    embed,
    jaccard,
    katz,
    licenses,
    merkle,
    mix,
    oracles,
    orderhash,
    packing,
    pii,
    quality,
    variants,
)
from siteratio.runtime import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken_words(table(spark, sf_dir, "documents"))


@query("op2_license_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset"
    )


@query("op4_quality_discriminant")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_partenum_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op6_katz_backoff")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return katz.Model(documents).score(documents)


@query("op7_pii_anchors")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of_kind(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


@query(
    "op8_content_addressed_warc",
    """
    WITH d AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
             sha256(encode(coalesce(html, ''))) AS payload_digest
      FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_page FROM d GROUP BY payload_digest)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page
                THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_page
                THEN first_page END AS refers_to
    FROM d JOIN f USING (payload_digest)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive.write_archive(table(spark, sf_dir, "pages"), path)
    return archive.read_archive(spark, path).select(
        "page_id", "payload_bytes", F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to"
    )


@query(
    "op10_p_stable_vectors",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.x, b.x) >= 0.98),
    reach AS (
      SELECT a AS id, a AS root FROM links
      UNION
      SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
    least_id AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
    degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, e.vec_id)::BIGINT AS component_id,
           coalesce(root, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN degree d ON d.id = e.vec_id LEFT JOIN least_id r ON r.id = e.vec_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_kd_spelling", oracles.SPELLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_bitmap_merkle", oracles.MERKLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.document_leaves(table(spark, sf_dir, "documents"), merkle.without_newlines())
    return merkle.manifest(leaves).withColumnRenamed("id", "doc_id")


@query("op13_heap_bpe_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bytepairs.count_tokens(table(spark, sf_dir, "documents"), PIECES)
    return counted.withColumn("over_limit", bytepairs.over_limit(4096))

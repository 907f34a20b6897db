"""The registered queries of this package, one an operator, and the pipeline."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, chat_quotes, document_fingerprints, filter_audit, html_text, language_id, line_dedup, mixing, nearest_neighbours, ngram_jaccard, sentencepiece_codec, substring_dedup, warc
from .store import shared_path

#: Path of the SentencePiece model, the same on every executor.
PIECE_MODEL = os.environ.get("BOOTFRAME_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests."""
    out = sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    return out.drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: its lines that went, and a digest of what stays."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), near="edit", min_words=0)
    return out.select("doc_id", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, epochs=2)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every message replies to, its place in reply order and a digest of its own words."""
    out = chat_quotes.reply_order(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "reply_to", "quote_levels", "quoted_lines", "matched_lines", "thread", F.array_join("path", "/").alias("path"), F.sha2(F.coalesce("own", F.lit("")), 256).alias("own_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document by links of 3-word shingles at Jaccard similarity 0.9."""
    out = ngram_jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    return nearest_neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive in the shared folder and read back."""
    path = shared_path(spark, "archives")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    out = warc.payloads(warc.read_warc(spark, path))
    return out.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat one of a document with a smaller id."""
    out = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    return out.withColumnsRenamed({"doc": "doc_id", "of_doc": "of_doc_id"})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose id's crc32 modulo 4 isn't 2."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.bucket(F.col("doc_id")) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likenesses."""
    return document_fingerprints.compared_with_next(_table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html_text.main_text(pages.select("page_id", "url", "html"), html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after three rounds from 16 centroids."""
    return centroid_clusters.clusters(_table(spark, sf_dir, "embeddings"), dim=64, k=16, rounds=3, scale=64)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of every order, by language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_chat_quotes": op4_chat_quotes,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_html_text": op11_html_text,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op12_centroid_clusters": centroid_clusters.ORACLE, "op13_filter_audit": filter_audit.ORACLE}

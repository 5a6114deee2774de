"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.llm import bpe, fingerprint, linededup, packing, pii, quality, simhash, tokenbin, tokencount, warc
from verispan.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tokenbin.write(documents(spark, sf_dir).select("doc_id", "text"))
    return tokenbin.read(index).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return tokencount.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _edited(rows: list[tuple]) -> list[tuple]:
    """Of (text, fingerprint, next_text, next_fingerprint): what op6 says of the text whose last half gave way to the next one's head."""
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, _, u, _ in rows]
    marks = fingerprint.signatures(edited)
    return [(len(t), hashlib.sha256(e.encode()).hexdigest(), m, x, n) for (t, m, _, n), e, x in zip(rows, edited, marks, strict=True)]


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    turn = fingerprint.in_turn(documents(spark, sf_dir), mark=fingerprint.signatures, then=_edited, fields=fields)
    own = F.col("fingerprint")
    return turn.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprint.likeness(own, F.col("edited_fingerprint")).alias("near_edited"), fingerprint.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    full = F.col("record_type") == "response"
    return warc.read(index).select(
        "page_id",
        F.when(full, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"))
    return bpe.decode(ids.select("doc_id", "ids")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    of = lambda kind: F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_warc": op7_warc,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {"op1_quality_rules": quality.oracle_sql()}

ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
ORACLE["op3_line_dedup"] = linededup.ORACLE

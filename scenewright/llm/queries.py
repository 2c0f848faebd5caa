"""The queries op1 to op10 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, decontam, exact, licenses, lines, mixing, quality, secret_scan, simhash, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = quality.learn(docs, labels.filter(~quality.held_out("doc_id")))
    scored = quality.score(docs, ranking)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= quality.ACCEPT, 1).otherwise(0).alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_tokens(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), str(model))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(spark, table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_exact": op4_exact,
    "op5_tokens": op5_tokens,
    "op6_licenses": op6_licenses,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_decontam": op9_decontam,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op4_exact": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents
        ), k AS (
            SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY h ORDER BY size DESC, doc_id) AS keep_id
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
    """,
    "op8_mixing": mixing.MIX_SQL.format(docs="documents"),
    # a SHA-1 of 160 bits as four numbers of 40, each eight digits of base 32
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, row_number() OVER () AS rid, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
        ), d AS (
            SELECT p.*, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       CAST((CAST('0x' || substr(h, CAST(k // 8 AS INTEGER) * 10 + 1, 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
                   row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, rid) AS r, min(page_id) OVER (PARTITION BY h) AS first_id
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first_id END AS refers_to FROM d
    """,
}

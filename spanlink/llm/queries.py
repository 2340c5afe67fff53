"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, license_scan, mixing, near_dup, quality_net, quality_rules, token_files, warc
from .common import crc_bucket, table


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_minhash": op3_minhash, "op4_license_scan": op4_license_scan, "op5_quality_rules": op5_quality_rules, "op9_decontaminate": op9_decontaminate, "op10_mixing": op10_mixing}
ORACLE_SQL: dict[str, str] = {"op3_minhash": near_dup.ORACLE, "op4_license_scan": license_scan.ORACLE, "op7_warc": warc.ORACLE, "op9_decontaminate": decontaminate.ORACLE}


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES |= {"op8_token_files": op8_token_files}


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = language_id.train(docs.where("not held_out"))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


QUERIES |= {"op7_warc": op7_warc, "op1_language_id": op1_language_id}


def op6_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)
    net = quality_net.train(docs.where("not held_out"), labels)
    return quality_net.score(docs, net, threshold=0.3, keep=("doc_id", "held_out"))


QUERIES |= {"op6_quality_net": op6_quality_net}


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"), html_text.train())


QUERIES |= {"op2_html_text": op2_html_text}

"""A training corpus in five stages: language ID, near-dedup, decontamination, mixing, token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlink.llm import decontaminate, language_id, mixing, near_dup, token_files
from spanlink.llm.common import discard, materialize, table

#: No SQL: Kneser-Ney scores, MinHash candidates and hash orders have no SQL form.
ORACLE_SQL = None
#: Near-duplicates: linked at so many percent; with so many halves, two texts at that similarity meet with probability 0.9999.
PERCENT, HALVES = 80, 14


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null, letterless or unlike all training texts go.

    Without a row that has text and lang there is no known language, and all rows go. An empty table gives an empty one.
    """
    model = language_id.train(docs)
    known = language_id.identify(docs, model, reject=True, keep=tuple(docs.columns))
    return known.where("lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id; texts without words all stay.

    Where doc_ids are null or repeat, rows are told apart by a hash of doc_id and text: each is compared by its own text, null
    ids come last in a group, and rows equal in both count as one. An empty table gives an empty one.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id is null or c > 1").isEmpty():
        groups = near_dup.near_duplicates(docs, k=5, percent=PERCENT, halves=HALVES)
        gone = materialize(groups.where("not kept").select("doc_id"), "duplicates")
        discard(groups)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    row = F.xxhash64(docs["doc_id"], docs["text"])
    keyed = materialize(docs.select(row.alias("doc_id"), docs["doc_id"].alias("id"), "text", F.struct(*docs.columns).alias("row")), "keyed")
    groups = near_dup.near_duplicates(keyed, k=5, percent=PERCENT, halves=HALVES)
    ids = keyed.select("doc_id", "id").distinct().join(groups.select("doc_id", "component_id"), "doc_id")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "doc_id")).alias("first"))
    stay = materialize(first.select("first.doc_id"), "stay")
    discard(groups)
    left = keyed.join(stay, "doc_id", "left_semi")
    one = left.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text; an empty benchmark or table changes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies; documents without words go."""
    return mixing.mixed(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, as read back: doc_id, start, n_tokens, ids_crc32; an empty table gives no files and no rows."""
    return token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", languages), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmark), ("mix", mix_sources), ("tokens", token_rows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # it has read them all
    discard(docs)
    return out

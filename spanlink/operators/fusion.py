"""Reciprocal-rank fusion of candidate tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ("q", "t", "retrieval_source", "rank", "retrieval_score")


def validate_candidates(df: DataFrame) -> DataFrame:
    """df, if it has the candidate columns, no null ids and ranks from 1; one aggregate checks it."""
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"candidate columns are missing: {missing}")
    bad = df.agg(F.count_if(F.col("q").isNull() | F.col("t").isNull()).alias("nulls"), F.count_if(F.col("rank").isNull() | (F.col("rank") < 1)).alias("ranks")).first()
    if bad["nulls"] or bad["ranks"]:
        raise ValueError(f"{bad['nulls']} null ids, {bad['ranks']} ranks under 1")
    return df


def fuse_candidates(frames: list[DataFrame], top_k: int, rrf_k: int = 60, source_weights: dict[str, float] | None = None, per_source_cap: int | None = None, check: bool = True) -> DataFrame:
    """(q, t, fused_score, best_rank, max_retrieval_score, source_count, sources, fused_rank), top_k a query."""
    frames = [validate_candidates(f) if check else f for f in frames]
    rows = reduce(DataFrame.unionByName, [f.select("q", "t", "retrieval_source", F.col("rank").cast("int"), F.col("retrieval_score").cast("double")) for f in frames])
    if per_source_cap:
        rows = rows.where(F.col("rank") <= per_source_cap)
    weight = F.lit(1.0)
    for source, w in (source_weights or {}).items():
        weight = F.when(F.col("retrieval_source") == source, float(w)).otherwise(weight)
    fused = rows.groupBy("q", "t").agg(
        F.sum(weight / (rrf_k + F.col("rank"))).alias("fused_score"), F.min("rank").alias("best_rank"), F.max("retrieval_score").alias("max_retrieval_score"),
        F.countDistinct("retrieval_source").alias("source_count"), F.array_sort(F.collect_set("retrieval_source")).alias("sources"))
    order = W.partitionBy("q").orderBy(F.desc(F.round("fused_score", 12)), "best_rank", "t")
    return fused.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= top_k)

"""Selection: exclusivity, expected-F decoding, thresholds, hard negatives, budgets, folds, splits and samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stable_hash

STRATEGIES = ("threshold", "threshold_exclusive", "expected_f", "expected_f_exclusive", "pi_exclusive")


def exclusive_mask(score: str = "score") -> Column:
    """True for the query that keeps a target: largest score, then smallest query."""
    return F.row_number().over(W.partitionBy("t").orderBy(F.desc(score), "q")) == 1


def apply_exclusivity(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("__keep", exclusive_mask(score)).where("__keep").drop("__keep")


#: Chances below this are left out of expected F.
LEAST_MASS = 1e-12


def success_counts(p: np.ndarray) -> np.ndarray:
    """Distribution of the number of successes of independent trials."""
    return _running_counts(p)[-1]


def _running_counts(p: np.ndarray) -> list[np.ndarray]:
    """success_counts of the first 0, 1, ... len(p) trials."""
    out = [np.ones(1)]
    for x in p:
        last = out[-1]
        grown = np.zeros(len(last) + 1)
        grown[:-1] = last * (1 - x)
        grown[1:] += last * x
        out.append(grown)
    return out


def best_count(p: np.ndarray, extra_miss: float, beta: float, allow_empty: bool = True) -> tuple[int, float]:
    """How many of the sorted probabilities to select for the largest expected F, and its value; fewer wins ties.

    The distributions of hits among the first k and of misses among the others come from one pass from each end.
    """
    b2 = beta * beta
    best, value = (0, float(np.prod(1 - p)) * math.exp(-extra_miss)) if allow_empty else (0, -1.0)
    first, rest = _running_counts(p), _running_counts(p[::-1])
    for k in range(1, len(p) + 1):
        inside, outside = (np.where(x < LEAST_MASS, 0.0, x) for x in (first[k], rest[len(p) - k]))
        tp, fn = np.arange(k + 1)[:, None], np.arange(len(p) - k + 1)[None]
        got = float(inside @ ((1 + b2) * tp / (k + b2 * (tp + fn + extra_miss))) @ outside)
        if got > value + LEAST_MASS:
            best, value = k, got
    return best, value


def _count_udf(extra_miss: float, beta: float, floor: float, gated: bool):
    @F.pandas_udf("int")
    def run(scores: pd.Series, existence: pd.Series) -> pd.Series:
        known: dict = {}

        def one(p, e) -> int:
            key = (tuple(p), e)
            if key not in known:
                p = np.where((p := np.asarray(p, float)) < floor, 0.0, p)
                if not gated:
                    known[key] = best_count(p, extra_miss, beta)[0]
                else:
                    pi = min(1.0, max(1e-9, 0.0 if e is None or np.isnan(e) else float(e), p.max(initial=0.0)))
                    k, value = best_count(np.minimum(1.0, p / pi), extra_miss, beta, allow_empty=False)
                    known[key] = k if pi * value > 1 - pi else 0
            return known[key]

        return pd.Series([None if p is None else one(p, e) for p, e in zip(scores, existence, strict=True)], dtype="Int32")

    return run


def expected_f_select(df: DataFrame, score: str = "score", beta: float = 0.5, k_max: int = 25, extra_miss: float = 0.0, floor: float = 1e-3, existence: DataFrame | None = None) -> DataFrame:
    """Adds selected: the query's first k rows (score descending, target ascending), k for the largest expected F.

    The k_max best scores of a query, in order, stand in its first row alone, by the window that ranks the rows; these rows go
    through one Arrow UDF and k spreads over the same partitions, so edges are shuffled once. Queries of equal scores are
    decided once a task. existence (q, existence) turns on the gated form.
    """
    by_q = W.partitionBy("q")
    order = by_q.orderBy(F.desc(score), "t")
    ahead = F.collect_list(score).over(order.rowsBetween(0, k_max - 1))
    ranked = df.withColumn("__n", F.row_number().over(order)).withColumn("__ps", F.when(F.col("__n") == 1, ahead))
    ranked = ranked.join(existence.select("q", F.col("existence").alias("__e")), "q", "left") if existence is not None else ranked.withColumn("__e", F.lit(None).cast("double"))
    counted = ranked.withColumn("__k", _count_udf(extra_miss, beta, floor, existence is not None)("__ps", "__e"))
    return counted.withColumn("selected", F.col("__n") <= F.max("__k").over(by_q)).drop("__n", "__k", "__ps", "__e")


def decode_pairs(df: DataFrame, strategy: str = "expected_f_exclusive", threshold: float = 0.5, beta: float = 0.5, k_max: int = 25, extra_miss: float = 0.0, existence: DataFrame | None = None) -> DataFrame:
    """Scored pairs with selected; scores are clipped to [0, 1], and losers of exclusivity count as 0 before expected-F decoding."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    df = df.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score").cast("double"))))
    if strategy == "threshold":
        return df.withColumn("selected", F.col("score") >= threshold)
    if strategy == "threshold_exclusive":
        return df.withColumn("selected", exclusive_mask() & (F.col("score") >= threshold))
    if strategy == "pi_exclusive" and existence is None:
        raise ValueError("pi_exclusive needs a table of existence probabilities")
    p = F.col("score") if strategy == "expected_f" else F.when(exclusive_mask(), F.col("score")).otherwise(0.0)
    out = expected_f_select(df.withColumn("__p", p), "__p", beta, k_max, extra_miss, existence=existence if strategy == "pi_exclusive" else None)
    return out.withColumn("selected", F.col("selected") & (F.col("__p") > 0)).drop("__p")


def sorted_decisions(df: DataFrame) -> DataFrame:
    return df.orderBy("q", F.desc("score"), "t")


def threshold_sets(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= threshold).groupBy("q").agg(F.array_sort(F.collect_set("t")).alias("ts"))


def candidate_sets(df: DataFrame) -> DataFrame:
    return df.groupBy("q").agg(F.array_sort(F.collect_set("t")).alias("ts"))


def threshold_table(df: DataFrame, truth: DataFrame, grid: list[float], queries: DataFrame | None = None, score: str = "score") -> DataFrame:
    """(threshold, macro_f05): every query counts, also those without a truth or prediction; one pass for all thresholds."""
    queries = (queries if queries is not None else df.select("q").unionByName(truth.select("q"))).select("q").distinct()
    hits = df.join(truth.select("q", "t").distinct().withColumn("__hit", F.lit(1)), ["q", "t"], "left")
    per = hits.groupBy("q").agg(*[F.count_if(F.col(score) >= x).alias(f"p{i}") for i, x in enumerate(grid)], *[F.count_if((F.col(score) >= x) & F.col("__hit").isNotNull()).alias(f"h{i}") for i, x in enumerate(grid)])
    sizes = truth.select("q", "t").distinct().groupBy("q").agg(F.count("*").alias("n"))
    base = queries.join(sizes, "q", "left").join(per, "q", "left").na.fill(0)
    f = lambda i: F.when(F.col("n") == 0, (F.col(f"p{i}") == 0).cast("double")).otherwise(1.25 * F.col(f"h{i}") / (0.25 * F.col("n") + F.col(f"p{i}")))
    means = base.agg(*[F.avg(f(i)).alias(f"m{i}") for i in range(len(grid))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"m{i}").alias("macro_f05")) for i, x in enumerate(grid)])).alias("r")).select("r.*")


def tune_threshold(df: DataFrame, truth: DataFrame, grid: list[float], queries: DataFrame | None = None, score: str = "score") -> tuple[float, float]:
    """The best threshold, the higher of equals, and its value."""
    r = threshold_table(df, truth, grid, queries, score).orderBy(F.desc("macro_f05"), F.desc("threshold")).first()
    return r["threshold"], r["macro_f05"]


def mine_hard_negatives(df: DataFrame, per_query: int = 10, per_target: int = 3, floor: float = 0.01) -> DataFrame:
    """Negatives among the top of their query or of their target, once, with the first reason that holds."""
    n = df.where((F.col("label") == 0) & (F.col("score") >= floor))
    n = n.withColumns({"__q": F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "t")), "__t": F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "q"))})
    n = n.where((F.col("__q") <= per_query) | (F.col("__t") <= per_target))
    return n.withColumn("hard_source", F.when(F.col("__q") <= per_query, "query_confusion").otherwise("target_competition")).drop("__q", "__t")


def ambiguity(df: DataFrame) -> DataFrame:
    """(q, ambiguity): nearness of the best score to a half, and of the best two to each other."""
    n = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "t"))
    two = df.withColumn("__n", n).where(F.col("__n") <= 2).groupBy("q").agg(F.max("score").alias("a"), F.coalesce(F.max(F.when(F.col("__n") == 2, F.col("score"))), F.lit(0.0)).alias("b"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return two.select("q", (clip(1 - 2 * F.abs(F.col("a") - 0.5)) + clip(1 - (F.col("a") - F.col("b")))).alias("ambiguity"))


def ambiguous_queries(df: DataFrame, fraction: float = 0.2, max_queries: int = 500_000) -> DataFrame:
    a = ambiguity(df)
    return a.orderBy(F.desc(F.round("ambiguity", 9)), "q").limit(min(max_queries, math.floor(df.select("q").distinct().count() * fraction)))


def split_for(key: Column, seed: int) -> Column:
    """fit, calibration or holdout, 60, 20 and 20 in a hundred."""
    at = F.pmod(stable_hash(F.concat(F.lit(f"split:{seed}:"), key.cast("string"))), F.lit(100))
    return F.when(at < 60, "fit").when(at < 80, "calibration").otherwise("holdout")


def sampled(key: Column, population: int, n: int, seed: int) -> Column:
    return stable_hash(F.concat(F.lit(f"sample:{seed}:"), key.cast("string"))) / float(2**63) < min(1.0, n / max(1, population))


def evaluation_role(key: Column, population: int, n: int, seed: int) -> Column:
    split = split_for(key, seed)
    return F.when(sampled(key, population, n, seed) & split.isin("calibration", "holdout"), split).otherwise("fit")


def assign_group_folds(df: DataFrame, q: str = "q", folds: int = 5, seed: int = 42) -> DataFrame:
    if folds < 2:
        raise ValueError("two folds at least")
    return df.withColumn("fold", F.pmod(stable_hash(F.concat(F.lit(f"{seed}:"), F.col(q).cast("string"))), F.lit(folds)).cast("short"))


def country_holdout(df: DataFrame, country: str, column: str = "country") -> tuple[DataFrame, DataFrame]:
    """(others, the country's): a null country is in neither."""
    return df.where(F.col(column) != country), df.where(F.col(column) == country)


def sample_entities(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.where(sampled(F.col(key), df.count(), n, seed)).withColumn("split", split_for(F.col(key), seed))


def exact_predictions(pairs: DataFrame) -> DataFrame:
    """Pairs of equal, non-blank names, addresses and countries."""
    same = lambda c: F.col(f"q_{c}") == F.col(f"t_{c}")
    return pairs.where(same("name") & same("address") & same("country") & (F.col("q_name") != "") & (F.col("q_address") != ""))

"""Character n-gram TF-IDF: an inverted index of postings joined on terms, and products of different texts in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .values import add_by_values, broadcast_if_small, spread

#: Targets of a term that one task joins, about.
HOT = 20_000
#: Different texts of queries and of targets that one task multiplies at once, about, and bytes of its table of weights.
QUERY_TEXTS, TARGET_TEXTS, TABLE_BYTES = 4096, 2048, 48 << 20


def char_grams(text: Column, low: int, high: int) -> Column:
    """n-grams inside single-space padded words; a word shorter than n is one gram of its own, once."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, n))
    used = lambda w: F.filter(sizes, lambda n: (n == low) | (F.length(w) >= n))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(used(w), lambda n: cut(w, n)))))


def term_counts(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.explode(char_grams(F.col(text), low, high)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit_idf(counts: DataFrame, n_docs: int, min_df: int = 2, max_features: int | None = 400_000, times: Column | None = None) -> DataFrame:
    """(term, idf): smooth idf of terms in min_df texts or more; the most frequent max_features of them. times: the texts that a row stands for."""
    times = F.lit(1) if times is None else times
    stats = counts.groupBy("term").agg(F.sum(times).alias("df"), F.sum(F.col("tf") * times).alias("total")).where(F.col("df") >= min_df)
    if max_features:
        stats = stats.orderBy(F.desc("total"), "term").limit(max_features)
    return stats.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def text_idf(texts: DataFrame, text: str, low: int = 3, high: int = 5, min_df: int = 2, max_features: int | None = 400_000, times: Column | None = None) -> DataFrame:
    """fit_idf of the texts of all rows; equal texts are cut once and count as often as they occur. times: the texts that a row stands for."""
    kinds = spread(texts.groupBy(text).agg(F.sum(F.lit(1) if times is None else times).alias("n")))
    n_docs = kinds.agg(F.sum("n")).first()[0] or 0
    counts = term_counts(kinds, text, text, low, high).join(kinds.select(F.col(text).alias("id"), "n"), "id")
    return fit_idf(counts, n_docs, min_df, max_features, F.col("n"))


def weigh(counts: DataFrame, idf: DataFrame, sublinear: bool = False) -> DataFrame:
    """(id, term, w): unit-length postings."""
    tf = F.log("tf") + 1 if sublinear else F.col("tf").cast("double")
    raw = counts.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def fit(targets: DataFrame, key: str, text: str, low: int = 3, high: int = 5, min_df: int = 2, max_features: int | None = 400_000, sublinear: bool = False) -> tuple[DataFrame, DataFrame]:
    """(idf, postings) of the targets."""
    counts = term_counts(targets, key, text, low, high)
    idf = fit_idf(counts, targets.count(), min_df, max_features)
    return idf, weigh(counts, idf, sublinear)


def search(queries: DataFrame, key: str, text: str, idf: DataFrame, postings: DataFrame, top_k: int, source: str, low: int = 3, high: int = 5, sublinear: bool = False) -> DataFrame:
    """Candidates by cosine, ranked 1 to top_k (score descending, target ascending); pairs without a common term are left out.

    Postings of a term that more than HOT targets have are dealt to several parts, each of which meets all queries of the term,
    so no term is one task; the products are summed in each task before the shuffle.
    """
    q = weigh(term_counts(queries, key, text, low, high), idf, sublinear)
    heavy = postings.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("term", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = postings.join(heavy, "term", "left").select(F.col("id").alias("t"), "term", "w", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    asked = q.join(heavy, "term", "left").select(F.col("id").alias("q"), "term", F.col("w").alias("wq"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = asked.join(dealt, ["term", "part"])
    scores = met.groupBy("q", "t").agg(F.sum(F.col("wq") * F.col("w")).alias("retrieval_score"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("retrieval_score", 9)), "t"))).where(F.col("rank") <= top_k)
    return ranked.select("q", "t", F.lit(source).alias("retrieval_source"), "rank", "retrieval_score")


def _vectors(texts: DataFrame, idf: DataFrame, low: int, high: int, sublinear: bool) -> DataFrame:
    """(text, terms, ws) of different texts that have a term."""
    unit = weigh(term_counts(spread(texts), "text", "text", low, high), idf, sublinear)
    rows = unit.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    return rows.select(F.col("id").alias("text"), F.col("v.term").alias("terms"), F.col("v.w").alias("ws"))


def _block_products(top_k: int):
    """For two blocks of vectors: each query's texts that may hold one of its best top_k targets, by texts' numbers of targets n."""

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows, cols, scores = ([np.zeros(0, kind)] for kind in (np.int64, np.int64, np.float64))
        if len(q) and len(t):
            codes, terms = pd.factorize(np.concatenate(t["terms"].to_numpy()))
            lengths, weights = t["terms"].map(len).to_numpy(), np.concatenate(t["ws"].to_numpy())
            ends = np.cumsum(lengths)
            at = pd.Index(terms)
            asked = []  # each query's terms that the block has
            for x, w in zip(q["terms"], q["ws"], strict=True):
                i = at.get_indexer(x)
                asked.append((i[i >= 0], np.asarray(w)[i >= 0]))
            times = t["n"].to_numpy()
            step = max(1, TABLE_BYTES // (8 * len(terms)))
            for a in range(0, len(t), step):
                b = min(len(t), a + step)
                part = slice(ends[a] - lengths[a], ends[b - 1])
                table = np.zeros((len(terms), b - a))
                table[codes[part], np.repeat(np.arange(b - a), lengths[a:b])] = weights[part]
                for k, (i, w) in enumerate(asked):
                    s = w @ table[i]
                    best = np.argpartition(-s, top_k - 1)[:top_k] if b - a > top_k else np.arange(b - a)
                    best = best[np.argsort(-s[best], kind="stable")]
                    enough = np.searchsorted(np.cumsum(times[a:b][best]), top_k)  # better texts have top_k targets
                    least = s[best[enough]] - 3e-9 if enough < len(best) else 0.0  # ranks round scores to 9 digits
                    kept = np.flatnonzero((s >= least) & (s > 0))
                    rows.append(np.full(len(kept), k))
                    cols.append(a + kept)
                    scores.append(s[kept])
        at_q, at_t = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame({"q": q["text"].to_numpy()[at_q], "t": t["text"].to_numpy()[at_t], "n": t["n"].to_numpy()[at_t], "score": np.concatenate(scores)})

    return run


def search_texts(queries: DataFrame, targets: DataFrame, text: str, top_k: int, source: str, low: int = 3, high: int = 5, min_df: int = 2, max_features: int | None = 400_000, sublinear: bool = False) -> DataFrame:
    """search of queries (q, text) in targets (t, text) by the targets' idf, where equal texts are multiplied once.

    Blocks of different query texts meet blocks of different target texts, and a task keeps what may be in the top k: all texts but those
    that top_k targets are better than. Only then texts become records again, so common terms and equal texts make no rows.
    """
    idf = stored(text_idf(targets, text, low, high, min_df, max_features), "idf")
    kinds = lambda df: df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n"))
    t_kinds = kinds(targets)
    side = lambda k: stored(_vectors(k.select("text"), idf, low, high, sublinear).join(k, "text"), "vectors")
    qv, tv = side(kinds(queries)), side(t_kinds)
    nq, nt = max(1, -(-qv.count() // QUERY_TEXTS)), max(1, -(-tv.count() // TARGET_TEXTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    left = qv.withColumn("a", own(nq)).withColumn("b", every(nt))
    right = tv.withColumn("b", own(nt)).withColumn("a", every(nq))
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_block_products(top_k), "q string, t string, n long, score double")
    met = met.withColumn("shown", F.round("score", 9))
    before = F.coalesce(F.sum("n").over(W.partitionBy("q").orderBy(F.desc("shown"), "t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    better = F.min("before").over(W.partitionBy("q", "shown"))
    few = met.withColumn("before", before).withColumn("better", better).where(F.col("better") < top_k).select(F.col("q").alias("asked"), F.col("t").alias("text"), "score", "shown")
    first = targets.select("t", F.col(text).alias("text")).withColumn("place", F.row_number().over(W.partitionBy("text").orderBy("t"))).where(F.col("place") <= top_k)
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("shown"), "t"))
    ranked = stored(few.join(first, "text").withColumn("rank", rank).where(F.col("rank") <= top_k).select("asked", "t", "rank", "score"), "ranked")
    out = queries.select("q", F.col(text).alias("asked")).join(ranked, "asked")
    return out.select("q", "t", F.lit(source).alias("retrieval_source"), "rank", F.col("score").alias("retrieval_score"))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Adds the dot product of two sets of postings for the given pairs; 0 without a common term."""
    a = pairs.select("q", "t").distinct().join(left.select(F.col("id").alias("q"), "term", F.col("w").alias("wq")), "q")
    s = a.join(right.select(F.col("id").alias("t"), "term", "w"), ["t", "term"]).groupBy("q", "t").agg(F.sum(F.col("wq") * F.col("w")).alias(name))
    return pairs.join(s, ["q", "t"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def text_cosine(pairs: DataFrame, left: str, right: str, idf: DataFrame, name: str, low: int = 3, high: int = 5, sublinear: bool = False, decimals: int | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Adds the cosine of the texts in columns left and right, 0 without a common term: each pair of different texts is multiplied once."""

    def cosine(kinds: DataFrame) -> DataFrame:
        asked = kinds.select(F.col(left).alias("q"), F.col(right).alias("t"))
        texts = asked.select(F.explode(F.array("q", "t")).alias("text")).distinct()
        unit = broadcast_if_small(stored(weigh(term_counts(spread(texts), "text", "text", low, high), idf, sublinear), "unit"))
        found = pair_cosine(asked, unit, unit, name)
        return found.select(F.col("q").alias(left), F.col("t").alias(right), F.round(name, decimals).alias(name) if decimals is not None else name)

    return add_by_values(pairs, left, right, cosine, kinds).withColumn(name, F.coalesce(name, F.lit(0.0)))


def save(idf: DataFrame, postings: DataFrame, path: str) -> None:
    idf.write.mode("overwrite").parquet(f"{path}/idf")
    postings.write.mode("overwrite").parquet(f"{path}/postings")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/postings")

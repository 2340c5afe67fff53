"""Pair features: lexical, modular and collective; labels and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import basic, numbers, tokens, words
from ..sources.sinks import stored
from .values import add_by_values

SCORES = ("combined_tfidf", "name_tfidf", "address_tfidf", "retrieval_combined", "retrieval_name", "retrieval_address", "name_ratio", "address_ratio")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if twice := df.groupBy(*keys).count().where("count > 1").limit(3).collect():
        raise ValueError(f"keys {keys} are not unique: {[tuple(r) for r in twice]}")
    return df


def _rounded(df: DataFrame, decimals: int | None) -> DataFrame:
    return df if decimals is None else df.withColumns({n: F.round(n, decimals) for n, k in df.dtypes if k == "double"})


def lexical_side(records: DataFrame, key: str) -> DataFrame:
    """What lexical_columns reads of a prepared record, prefixed by its key."""
    letters = F.array_join(F.transform(words(F.col("core")), lambda w: w.substr(1, 1)), "")
    shown = {"name": F.col("name"), "address": F.col("address"), "core": F.col("core"), "letters": letters, "named": F.col("business_name") != "", "unicode": basic(F.col("business_name")), "country": basic(F.col("country"))}
    return records.select(key, *[c.alias(f"{key}_{n}") for n, c in shown.items()])


def lexical_features(pairs: DataFrame, queries: DataFrame, targets: DataFrame, composites: bool = True) -> DataFrame:
    """The baseline's lexical columns of pairs (q, t, block_mask, retrieval_*, rank_*); queries and targets are prepared records."""
    met = pairs.join(lexical_side(queries, "q"), "q").join(lexical_side(targets, "t"), "t")
    return lexical_columns(stored(met, "met"), composites)  # written: it is read for each field and for the result


def _field_measures(kinds: DataFrame, f: str) -> DataFrame:
    """The lexical columns that the values of one field decide."""
    flag = lambda c: c.cast("int")
    a, b = F.col(f"q_{f}"), F.col(f"t_{f}")
    at, bt, fz = words(a), words(b), F.col("__f")
    out = {
        f"{f}_exact": flag((a != "") & (a == b)), f"{f}_missing": flag((a == "") | (b == "")), f"{f}_jaccard": S.jaccard(at, bt), f"{f}_overlap": S.overlap(at, bt), f"{f}_ratio": fz["ratio"], f"{f}_partial": fz["partial"],
        f"{f}_token_sort": fz["token_sort"], f"{f}_token_set": fz["token_set"], f"{f}_edit": S.edit_similarity(a, b), f"{f}_jaro": fz["jaro"], f"{f}_length_ratio": S.length_ratio(a, b), f"{f}_token_difference": F.abs(F.size(at) - F.size(bt)),
        f"{f}_prefix": flag((a != "") & (b != "") & (F.left(a, F.lit(4)) == F.left(b, F.lit(4)))), f"{f}_suffix": flag((a != "") & (b != "") & (F.right(a, F.lit(4)) == F.right(b, F.lit(4)))),
    }
    if f == "address":
        nq, nr = numbers(a), numbers(b)
        pq, pr = F.filter(nq, lambda x: F.length(x) >= 4), F.filter(nr, lambda x: F.length(x) >= 4)
        shared = F.size(F.array_intersect(pq, pr))
        out |= {
            "numeric_jaccard": S.jaccard(nq, nr), "numeric_disagreement": F.size(F.array_except(nq, nr)) + F.size(F.array_except(nr, nq)), "numeric_missing": flag((F.size(nq) == 0) | (F.size(nr) == 0)),
            "postal_overlap": shared, "postal_conflict": flag((F.size(pq) > 0) & (F.size(pr) > 0) & (shared == 0)),
        }
    return kinds.withColumn("__f", S.fuzzy(a, b, "ratio", "partial", "token_sort", "token_set", "jaro")).withColumns(out).drop("__f")


def lexical_columns(met: DataFrame, composites: bool = True, decimals: int | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """lexical_features of pairs that have the columns of lexical_side of both records, which go.

    What one field's values decide is computed once for each different pair of values; kinds: a shorter table with all of them.
    """
    mine = [f"{k}_{c}" for k in "qt" for c in ("name", "address", "core", "letters", "named", "unicode", "country")]
    first = [c for c in met.columns if c not in mine]
    flag = lambda c: c.cast("int")
    df, of = met, {}
    for f in ("name", "address"):
        df = add_by_values(df, f"q_{f}", f"t_{f}", lambda kinds, f=f: _rounded(_field_measures(kinds, f), decimals), met if kinds is None else kinds)
        of[f] = [c for c in df.columns if c not in met.columns and c not in sum(of.values(), [])]
    split = of["address"].index("numeric_jaccard")
    numeric = {c: F.col(c) for c in of["address"][split:]}
    out = {
        "core_exact": flag((F.col("q_core") != "") & (F.col("q_core") == F.col("t_core"))), "unicode_name_exact": flag(F.col("q_named") & (F.col("q_unicode") == F.col("t_unicode"))),
        "acronym_equal": flag((F.col("q_letters") != "") & (F.col("q_letters") == F.col("t_letters"))), **numeric, "same_country": flag(F.col("q_country") == F.col("t_country")),
        "source3": flag(F.col("t").startswith("S3-")), "retrieval_count": F.bit_count("block_mask"),
    }
    out |= {f"block_{i}": F.expr(f"cast(shiftright(block_mask, {i}) & 1 as int)") for i in range(11 if composites else 5)}
    product = F.col("name_ratio") * F.col("address_ratio")
    out |= {"name_address_product": product if decimals is None else F.round(product, decimals), "name_address_min": F.least("name_ratio", "address_ratio"), "name_strong_address_weak": flag((F.col("name_ratio") > 0.9) & (F.col("address_ratio") < 0.5))}
    return df.select(*first, *of["name"], *of["address"][:split], *[c.alias(n) for n, c in out.items()])


def pair_side(records: DataFrame, key: str) -> DataFrame:
    """A side's columns as pair_columns reads them, suffixed by its key."""
    return records.select(key, *[F.col(c).alias(f"{c}__{key}") for c in records.columns if c != key])


def build_pair_features(pairs: DataFrame, queries: DataFrame, targets: DataFrame, fields: tuple[str, ...] = ("name", "address"), check: bool = True) -> DataFrame:
    """Six measures for each field in the native and the romanised view, same_country, same_script; numeric nulls become 0."""
    if check:
        require_unique(queries, "q")
        require_unique(targets, "t")
    met = pairs.join(pair_side(queries, "q"), "q", "left").join(pair_side(targets, "t"), "t", "left")
    return pair_columns(stored(met, "met"), fields)  # written: it is read for each view and for the result


def _view_measures(kinds: DataFrame, name: str, left: str, right: str) -> DataFrame:
    a, b = F.col(left), F.col(right)
    digits = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0)))
    return kinds.withColumn("__f", S.fuzzy(a, b, "ratio", "token_set")).withColumns({
        f"{name}_fuzzy": F.col("__f.ratio"), f"{name}_token_set": F.col("__f.token_set"), f"{name}_token_jaccard": S.jaccard(tokens(a), tokens(b)), f"{name}_digit_jaccard": S.jaccard(digits(a), digits(b)),
        f"{name}_length_ratio": S.length_ratio(a, b), f"{name}_exact": ((a != "") & (a == b)).cast("double")}).drop("__f")


def pair_columns(met: DataFrame, fields: tuple[str, ...] = ("name", "address"), decimals: int | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """build_pair_features of pairs that have the columns of pair_side of both records.

    The measures of a view are computed once for each different pair of values; kinds: a shorter table with all of them.
    """
    views = [(f"{f}{v}", f"{f}_{n}") for f in fields for v, n in (("", "norm"), ("_roman", "roman")) if f"{f}_{n}__q" in met.columns and f"{f}_{n}__t" in met.columns]
    full = lambda df: df.withColumns({f"__{c}_{k}": F.coalesce(F.col(f"{c}__{k}"), F.lit("")) for _, c in views for k in "qt"})
    df, made = full(met), []
    shorter = df if kinds is None else full(kinds)
    for name, c in views:
        left, right = f"__{c}_q", f"__{c}_t"
        df = add_by_values(df, left, right, lambda kinds, x=(name, left, right): _rounded(_view_measures(kinds, *x), decimals), shorter)
        made += [f"{name}_{m}" for m in ("fuzzy", "token_set", "token_jaccard", "digit_jaccard", "length_ratio", "exact")]
    df = df.select(*met.columns, *made)
    for what in ("country", "script"):
        if f"{what}__q" in df.columns and f"{what}__t" in df.columns:
            empty = lambda c: F.coalesce(F.col(c), F.lit(""))
            df = df.withColumn(f"same_{what}", (empty(f"{what}__q") == empty(f"{what}__t")).cast("int"))
    numeric = {n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in numeric_columns(df)}
    return df.withColumns(numeric)


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ("label", "y", "fold", "q", "t")) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, k in df.dtypes if k in kinds and n not in without]


def baseline_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("q", "t", "label", "probability", "split", "country")]


def add_collective(df: DataFrame, score: str = "score") -> DataFrame:
    """Query and target context of scored edges: two window partitions, no self-join and no gathered lists."""
    q, t = W.partitionBy("q"), W.partitionBy("t")
    s = F.col(score)
    place = F.row_number().over(W.partitionBy("t").orderBy(F.desc(score), "q"))
    df = df.withColumn("__place", place).withColumns({
        "t_score_max": F.max(s).over(t), "t_score_second": F.coalesce(F.max(F.when(F.col("__place") == 2, s)).over(t), F.lit(0.0)), "t_query_count": F.count("*").over(t),
        "q_score_max": F.max(s).over(q), "q_score_sum": F.sum(s).over(q), "q_candidate_count": F.count("*").over(q), "q_score_rank": F.row_number().over(W.partitionBy("q").orderBy(F.desc(score), "t"))})
    rival = F.when(s == F.col("t_score_max"), F.col("t_score_second")).otherwise(F.col("t_score_max"))
    return df.withColumns({"q_score_gap": F.col("q_score_max") - s, "t_score_gap": F.col("t_score_max") - s, "t_competition_margin": s - rival}).drop("__place")


def attach_labels(features: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("q", "t").distinct().withColumn("__hit", F.lit(1))
    return features.join(known, ["q", "t"], "left").withColumn("label", F.coalesce("__hit", F.lit(0)).cast("byte")).drop("__hit")


def select_training_rows(df: DataFrame, hard_negatives: int, role: str = "split", fit: str = "fit") -> DataFrame:
    """All rows outside the fit role, its positives, and each query's hardest negatives by the largest available score."""
    have = [F.col(c) for c in SCORES if c in df.columns]
    hard = F.greatest(*have) if len(have) > 1 else have[0]
    negative = (F.col(role) == fit) & (F.col("label") == 0)
    n = F.row_number().over(W.partitionBy("q", negative).orderBy(F.desc("__hard"), "t"))
    return df.withColumn("__hard", hard).withColumn("__n", n).where(~negative | (F.col("__n") <= max(0, hard_negatives))).drop("__hard", "__n")

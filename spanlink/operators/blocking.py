"""Signature blocking and exact retrieval: equality joins on keys, with caps per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy
from ..functions.text import words
from ..sources.sinks import stored
from .values import add_by_values

BASE, COMPOSITE = 5, 6


def _longest_first(ws: Column) -> Column:
    return F.array_sort(F.array_distinct(ws), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def signature_keys() -> Column:
    """Five readable keys of a prepared record; null where a key has nothing to say."""
    core = _longest_first(words(F.col("core")))
    anchor = F.coalesce(F.get(core, F.lit(0)), F.lit(""))
    streets = F.slice(_longest_first(F.filter(words(F.col("address")), lambda w: w.rlike(r"^\p{L}+$"))), 1, 2)
    keys = [F.array_join(F.array_sort(core), " "), F.when(F.length(anchor) >= 4, F.substring(anchor, 1, 5)), F.when(F.length(anchor) >= 4, F.right(anchor, F.lit(5))), F.col("digits"), F.when(F.size(streets) == 2, F.array_join(F.array_sort(streets), " "))]
    return F.array(*[F.nullif(k, F.lit("")) for k in keys])


def all_keys(composites: bool = True) -> Column:
    """The base keys and six composites: anchor ends with digits, and each of keys 1 to 4 with the first four characters of the core."""
    k = signature_keys()
    at = lambda i: F.get(k, F.lit(i))
    head = F.nullif(F.substring("core", 1, 4), F.lit(""))
    pairs = [(at(1), at(3)), (at(2), at(3))] + [(at(i), head) for i in (1, 2, 3, 4)]
    return F.concat(k, F.array(*[F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("|"), b)) for a, b in pairs])) if composites else k


def lookups(records: DataFrame, key: str, composites: bool = True) -> DataFrame:
    """(key, lookup, value): one row per record and key that it has."""
    return records.select(key, F.posexplode(all_keys(composites)).alias("lookup", "value")).where("value is not null")


def build_index(targets: DataFrame, composites: bool = True, check: bool = True) -> DataFrame:
    """(t, row, lookup, value). row orders targets as they were read: source 2 before source 3, then id, unless the table has it."""
    if check and (twice := targets.groupBy("t").count().where("count > 1").limit(5).collect()):
        raise ValueError(f"repeated target ids: {[r['t'] for r in twice]}")
    if "row" not in targets.columns:
        targets = targets.withColumn("row", F.struct(F.substring("t", 1, 3), F.col("t")))
    keyed = targets.select("t", "row", F.posexplode(all_keys(composites)).alias("lookup", "value"))
    return keyed.where("value is not null")


def block_candidates(queries: DataFrame, index: DataFrame, block_limit: int, composites: bool = True) -> DataFrame:
    """(q, t, block_mask, truncated). The cap depends on the key alone, so it is applied once, to the index side.

    Spark keeps a key's first rows in each task before the shuffle (a window group limit) for caps of up to 1000, so a common
    key sends no more than the cap from each task.
    """
    capped = index.withColumn("n", F.row_number().over(W.partitionBy("lookup", "value").orderBy("row", "t"))).where(F.col("n") <= block_limit + 1)
    cut = F.max("n").over(W.partitionBy("lookup", "value")) > block_limit
    capped = capped.withColumn("cut", cut).where(F.col("n") <= block_limit).select("lookup", "value", "t", "cut")
    met = lookups(queries, "q", composites).join(capped, ["lookup", "value"])
    return met.groupBy("q", "t").agg(F.bit_or(F.expr("shiftleft(1L, lookup)")).alias("block_mask"), F.sum(F.col("cut").cast("long")).alias("truncated"))


def prefilter(pairs: DataFrame, queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Pairs in the top k of the name, address or combined score, or equal in name and address; with scores and ranks."""
    side = lambda df, p: df.select(F.col(p), F.col("name").alias(f"{p}_name"), F.col("address").alias(f"{p}_address"))
    met = stored(pairs.join(side(queries, "q"), "q").join(side(targets, "t"), "t"), "met")
    return prefilter_columns(met, k).drop("q_name", "t_name", "q_address", "t_address")


def prefilter_columns(met: DataFrame, k: int) -> DataFrame:
    """prefilter of pairs that have the names and addresses of both records; a written table, since each field's values are read too."""
    scored = met
    for f in ("name", "address"):
        weighted = lambda kinds, a=f"q_{f}", b=f"t_{f}", to=f"retrieval_{f}": kinds.withColumn(to, fuzzy(F.col(a), F.col(b), "weighted")["weighted"])
        scored = add_by_values(scored, f"q_{f}", f"t_{f}", weighted, met)
    scores = [F.coalesce(f"retrieval_{f}", F.lit(0.0)).alias(f"retrieval_{f}") for f in ("name", "address")]
    scored = scored.select(*met.columns, *scores).withColumn("retrieval_combined", (F.col("retrieval_name") + F.col("retrieval_address")) / 2)
    exact = (F.col("q_name") == F.col("t_name")) & (F.col("q_address") == F.col("t_address")) & (F.col("q_name") != "")
    return top_by_views(scored.withColumn("exact", exact), k, ("name", "address", "combined"))


def top_by_views(scored: DataFrame, k: int, views: tuple[str, ...], prefix: str = "retrieval_", exact: str | None = "exact") -> DataFrame:
    """Union of each view's top k a query (score descending, target ascending), and of exact rows."""
    ranks = {f"rank_{v}": F.row_number().over(W.partitionBy("q").orderBy(F.desc(f"{prefix}{v}"), "t")) for v in views}
    keep = F.lit(False)
    for v in views:
        keep = keep | (F.col(f"rank_{v}") <= k)
    return scored.withColumns(ranks).where(keep | F.col(exact) if exact else keep)


def exact_candidates(queries: DataFrame, targets: DataFrame, fields: list[str], max_block: int = 500) -> DataFrame:
    """(q, t, retrieval_source, rank, retrieval_score): equal field values; blocks above max_block are left out whole.

    A pair counts for its first field only, and ranks run over the fields in order.
    """
    stack = lambda df, key: df.select(key, F.posexplode(F.array(*[F.col(f).cast("string") for f in fields])).alias("field", "value")).where("value is not null and trim(value) <> ''")
    index = stack(targets, "t")
    sizes = index.groupBy("field", "value").count().where(F.col("count") <= max_block).select("field", "value")
    met = stack(queries, "q").join(index.join(sizes, ["field", "value"], "left_semi"), ["field", "value"])
    first = met.groupBy("q", "t").agg(F.min("field").alias("field"))
    name = F.concat(F.lit("exact_"), F.get(F.array(*[F.lit(f) for f in fields]), F.col("field")))
    return first.select("q", "t", name.alias("retrieval_source"), F.row_number().over(W.partitionBy("q").orderBy("field", "t")).alias("rank"), F.lit(1.0).alias("retrieval_score"))

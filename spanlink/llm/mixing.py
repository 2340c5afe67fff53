"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The sources' targets share the total by weight, stop at `most` times a source's size and pass their excess on by weight.
Each source is dealt into shards by a seeded hash of the document; a cell is one source in one shard. Blocks of equal token
count are the seats, the cells' targets are the votes: the divisor at which the highest quotients use up all seats gives
each cell an integer quota. A cell's documents, in seeded hash order, are one stream of tokens; whole passes over it and
then its first blocks fill the quota. Only (doc_id, source, size) rows are shuffled, never texts.

Inputs: null, empty and blank texts have size 0 and are never taken; a null source is a source of its own, the last one;
rows that repeat a doc_id, null ids among them, are each a document of the mix: equal (doc_id, size) rows share one
interval each in turn, ordered by doc_id and size. Texts of any length count in full, and a long one is one document. More
than MAX_SOURCES sources raise. Columns of the input that are not needed are ignored. Empty tables give
empty tables.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACES, broadcast_if_small, materialize

WEIGHTS, MOST = (5, 2, 1), 3
#: Rows of a shard, about; and cells at most, which bounds what the driver apportions.
SHARD_ROWS, MAX_CELLS = 256, 100_000
#: Sources at most: the weights are of sources in order, so their sizes meet on the driver. More of them raise.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Target of each source, in order: shares by weight of the total of all sizes, none above most times its size."""
    want, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        share = {i: left * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in free) for i in free}
        full = [i for i in free if share[i] > most * sizes[i]]
        for i in full or free:
            want[i] = float(most * sizes[i]) if full else share[i]
        if not full:
            break
        left -= sum(want[i] for i in full)
        free -= set(full)
    return want


def apportion(votes: np.ndarray, seats: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague seats: the highest quotients votes / (2 s + 1), no more than limit each; ties go to the earlier cell."""
    votes = np.asarray(votes, float)
    limit = np.full(len(votes), seats, np.int64) if limit is None else np.asarray(limit, np.int64)
    limit = np.where(votes > 0, limit, 0)
    seats = int(min(seats, limit.sum()))
    won = lambda d: np.minimum(np.maximum(np.floor(votes / d + 0.5), 0).astype(np.int64), limit)
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = 1e-12 * max(votes.max(), 1e-300), 4 * votes.max() + 1  # won(high) is 0, won(low) is enough
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if won(mid).sum() >= seats else (low, mid)
    out = won(high)
    for _ in range(seats - int(out.sum())):  # the last quotients tie or lie within rounding
        quotient = np.where(out < limit, votes / (2 * out + 1), -1.0)
        out[int(np.argmax(quotient))] += 1
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17, block: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, with its source and row hash (source, row)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(NOT_SPACES + "+")).cast("long").alias("size"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"))
    sized = materialize(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()  # one row a source
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give documents a coarser source before they are mixed")
    order = sorted(by_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["size"] for r in order], weights, most)
    per_shard = max(shard_rows, ceil(sum(r["rows"] for r in order) / MAX_CELLS))
    known = docs.sparkSession.createDataFrame(
        [(r["source"], i, r["size"], t, max(1, ceil(r["rows"] / per_shard))) for i, (r, t) in enumerate(zip(order, want, strict=True))],
        "source string, source_no int, source_size long, target double, shards int")
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    placed = sized.alias("d").join(broadcast_if_small(known, 2 * MAX_CELLS).alias("s"), same).select("d.doc_id", "d.source", "d.size", "d.row", "s.source_no", "s.source_size", "s.target", F.pmod(F.xxhash64("d.row", F.lit(seed)), F.col("s.shards")).alias("shard"))
    cells = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).orderBy("source_no", "shard").collect()  # at most MAX_CELLS and one a source
    total = sum(r["size"] for r in order)
    block = block or max(1, total // (512 * max(1, len(cells))))
    sizes = np.array([c["size"] for c in cells], float)
    votes = np.array([want[c["source_no"]] * c["size"] / max(1, order[c["source_no"]]["size"]) for c in cells])
    quota = apportion(votes, round(sum(want) / block), np.floor(most * sizes / block)) if len(cells) else []
    rows = [(c["source_no"], c["shard"], int(c["size"]), int(q) * block) for c, q in zip(cells, quota, strict=True)]
    quotas = docs.sparkSession.createDataFrame(rows, "source_no int, shard long, cell_size long, quota long")
    before = F.sum("size").over(W.partitionBy("source_no", "shard").orderBy(F.xxhash64("row", F.lit(seed + 1)), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    streamed = placed.withColumn("before", F.coalesce(before, F.lit(0))).join(broadcast_if_small(quotas, 2 * MAX_CELLS), ["source_no", "shard"])
    passes = F.floor(F.col("quota") / F.greatest(F.col("cell_size"), F.lit(1)))
    rest = F.col("quota") - passes * F.col("cell_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return streamed.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), "source", "row")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as its taken words fill it, to the nearest whole number of copies."""
    plan = mix(docs, **options).where("size > 0").select("row", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias("copies")).where("copies > 0")
    plan = plan.groupBy("row").agg(F.max("copies").alias("copies"))
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id"), F.col("text")))
    joined = keyed.join(plan.withColumnRenamed("row", "__row"), "__row")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[docs[c] for c in docs.columns])

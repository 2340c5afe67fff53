"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) for every end of edges (a, b); comp is the smallest id reachable.

    Each round takes the least label among neighbours and then jumps to that label's own label, so a path of length n needs
    about log n rounds. Only labels move; no neighbour list is ever gathered. Empty edges give an empty table.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = written = materialize(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("comp").alias("jump"))
        moved = materialize(stepped.join(jump, "step", "left").select("id", "old", F.least("step", F.coalesce("jump", "step")).alias("comp")), "labels")
        settled = moved.where("old <> comp").isEmpty()
        discard(written)
        labels, written = moved.select("id", "comp"), moved
        if settled:
            discard(both)
            labels.spanlink_path = moved.spanlink_path  # the caller may discard it
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Restartable incremental scoring: new query files meet a static target index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_arrivals(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 8, available_now: bool = True, sep: str | None = "\t") -> StreamingQuery:
    """Score each new file's queries once. A batch overwrites its own folder, so a batch that runs again leaves no repeats."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.option("sep", sep).option("header", True).option("escape", '"').csv(source) if sep else reader.parquet(source)

    def batch(df: DataFrame, n: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts", *by: str) -> DataFrame:
    """Tumbling-window counts of arrivals, for monitoring; works on batch and streaming tables."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "rows")

"""Shared-folder tables, size-checked broadcasts and word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: Words of the white-space contracts, as Java and RE2 character classes.
SPACES = r"[\x20\x09-\x0D]"
NOT_SPACES = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where the session has none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanlink-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanlink-{name}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query ends, not when the driver next collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries that run inside go as soon as each has ended; lost ones are made anew by stage retries."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. The written table outlives lost executors and cuts the lineage; it goes with the application."""
    ship(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.spanlink_path = path
    _file_system(df.sparkSession, path).deleteOnExit(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path))  # what is not discarded before
    return written


def _file_system(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*written: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more; None and tables deleted before are passed over."""
    for df in written:
        if df is not None and getattr(df, "spanlink_path", None) is not None:
            drop_path(df.sparkSession, df.spanlink_path)
            df.spanlink_path = None


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


#: Bytes of batches after which a Python worker gives free memory back.
LEAN_BYTES = 32 << 20


def lean(batches):
    """Arrow batches of a worker, which gives the memory that it has freed back to the system now and then and at the end.

    Arrow's pool and the C library keep what they have freed; workers stay for later stages, so that would add up.
    """
    seen = 0
    for batch in batches:
        yield batch
        seen += batch.nbytes
        if seen >= LEAN_BYTES:
            seen = 0
            _give_back()
    _give_back()


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Bytes of a broadcast side at most.
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when df has at most max_rows rows and max_bytes bytes; otherwise Spark shuffles the join.

    Strings count with their length, arrays with 8 bytes an entry. df should be a written table or cheap: it runs once more.
    """
    wide = [F.coalesce(F.octet_length(f.name) if f.dataType.typeName() == "string" else F.size(f.name) * 8, F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "array")]
    sized = df.limit(max_rows + 1).select((sum(wide, F.lit(16 * len(df.columns)))).cast("long").alias("b"))
    found = sized.agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if found["n"] <= max_rows and (found["b"] or 0) <= max_bytes else df


def ascii_lower(text: Column) -> Column:
    """A-Z only; the fast path skips texts that have none of them."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES + "+")
    return F.filter(parts, lambda w: w != "")


def crc_bucket(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n

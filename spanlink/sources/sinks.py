"""Sinks: submissions, Parquet shards, reports, manifests and fingerprints."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import platform
import re
import tempfile
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_lists(queries: DataFrame, pairs: DataFrame, query: str = "q", target: str = "t") -> DataFrame:
    """(query, ids): one row a query, ids sorted and comma-joined, empty where nothing matched."""
    lists = pairs.groupBy(F.col(query).alias("__q")).agg(F.array_join(F.array_sort(F.collect_set(target)), ",").alias("ids"))
    return queries.join(lists, F.col(query) == F.col("__q"), "left").select(*[F.col(c) for c in queries.columns], F.coalesce("ids", F.lit("")).alias("ids"))


def check_submission(queries: DataFrame, matches: DataFrame, candidates: DataFrame) -> None:
    """The constraints of a submission, each a query that must be empty."""
    rules = {
        "a source-1 id is repeated": queries.groupBy("q").count().where("count > 1").select("q"),
        "a source-1 id lacks its prefix": queries.where(~F.col("q").startswith("S1-")).select("q"),
        "a target lacks its prefix": candidates.select("q", "t").unionByName(matches.select("q", "t")).where(~F.col("t").rlike("^S[23]-")).select("q", "t"),
        "a match is repeated": matches.groupBy("q", "t").count().where("count > 1").select("q", "t"),
        "a match is no candidate": matches.select("q", "t").join(candidates.select("q", "t"), ["q", "t"], "left_anti"),
        "a match has no query": matches.select("q").join(queries.select("q"), "q", "left_anti"),
    }
    for what, df in rules.items():
        if found := df.limit(5).collect():
            raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def write_submission(queries: DataFrame, matches: DataFrame, candidates: DataFrame, out: str, order: str | None = None) -> None:
    """matching_results and candidate_pairs as tab-separated text, in the order column's order where one is named."""
    check_submission(queries, matches, candidates)
    for name, pairs, column in (("matching_results", matches, "matched_entity_ids"), ("candidate_pairs", candidates, "candidate_entity_ids")):
        rows = match_lists(queries, pairs.select("q", "t"))
        rows = rows.orderBy(order or "q")
        head = queries.sparkSession.createDataFrame([(f"source1_entity_id\t{column}",)], "value string")
        lines = rows.select(F.concat_ws("\t", "q", "ids").alias("value"))
        lines.write.mode("overwrite").text(f"{out}/{name}.lines")
        head.coalesce(1).write.mode("overwrite").text(f"{out}/{name}.header")
        _assemble(queries.sparkSession, [f"{out}/{name}.header", f"{out}/{name}.lines"], f"{out}/{name}.tsv")


def _assemble(spark, folders: list[str], target: str) -> None:
    """Concatenate part files in name order into one file; the stream never passes through Python."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    partial = path(target + ".partial")
    stream = fs.create(partial, True)
    for folder in folders:
        names = sorted(s.getPath().toString() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
        for name in names:
            source = fs.open(path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 16, False)
            source.close()
        fs.delete(path(folder), True)
    stream.close()
    fs.delete(path(target), False)
    fs.rename(partial, path(target))


def write_shard(df: DataFrame, path: str) -> None:
    """zstd Parquet; the committer shows a job's files only when all are written."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_jsonl(pairs: DataFrame, path: str) -> None:
    pairs.select("query_text", "target_text", F.col("label").cast("int").alias("label")).write.mode("overwrite").json(path)


def scratch(spark) -> str:
    """A new folder that all executors share and that goes with the application: below spark.checkpoint.dir, or a local one where the session runs on this machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared.rstrip('/')}/spanlink-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="spanlink-")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back: what several later steps read is computed once."""
    path = f"{scratch(df.sparkSession)}/{name}.parquet"
    write_shard(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # without a job to read the schema


def atomic_json(value, path: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False) as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)


def markdown_report(title: str, value, path: str) -> None:
    Path(path).write_text(f"# {title}\n\n```json\n{json.dumps(value, indent=2, sort_keys=True, default=str)}\n```\n")


def markdown_sections(title: str, sections: dict, path: str) -> None:
    """One heading and JSON block for each section."""
    body = "\n\n".join(f"## {name}\n\n```json\n{json.dumps(value, indent=2, sort_keys=True, default=str, ensure_ascii=False)}\n```" for name, value in sections.items())
    Path(path).write_text(f"# {title}\n\n{body}\n", encoding="utf-8")


def csv_rows(rows: list[dict], path: str) -> None:
    """A small report that the driver has as rows."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, list(dict.fromkeys(k for r in rows for k in r)))
        w.writeheader()
        w.writerows(rows)


def record_experiment(path: str, row: dict) -> None:
    """Append to a .csv or .jsonl log."""
    row = {"recorded_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())} | row
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("a", newline="") as f:
        if target.suffix == ".jsonl":
            f.write(json.dumps(row, sort_keys=True, default=str) + "\n")
        else:
            w = csv.DictWriter(f, list(row))
            if f.tell() == 0:
                w.writeheader()
            w.writerow(row)


def file_fingerprint(path: str, hash_limit: int = 64 << 20) -> dict:
    p = Path(path)
    stat = p.stat()
    out = {"size": stat.st_size, "mtime_ns": stat.st_mtime_ns}
    if stat.st_size <= hash_limit:
        out["sha256"] = hashlib.sha256(p.read_bytes()).hexdigest()
    return out


def table_fingerprint(df: DataFrame) -> dict:
    """Rows and an order-free digest, in one aggregate."""
    r = df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest")).first()
    return {"rows": r["rows"], "digest": r["digest"]}


@contextmanager
def stage_manifest(path: str, stage: str, config: dict, inputs: dict | None = None):
    """A JSON record of a stage: running, then complete with its outputs, or failed."""
    record = {"stage": stage, "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(), "environment": {"python": platform.python_version(), "platform": platform.platform(), "cpus": os.cpu_count()}, "inputs": inputs or {}, "outputs": {}, "status": "running", "started_at": time.time()}
    atomic_json(record, path)
    try:
        yield record
    except BaseException as e:
        atomic_json(record | {"status": "failed", "error": str(e)[:500], "finished_at": time.time()}, path)
        raise
    atomic_json(record | {"status": "complete", "finished_at": time.time()}, path)


def check_config(record: dict, config: dict) -> None:
    """Refuse settings that differ from those a model was made with."""
    if record["config_sha256"] != hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest():
        raise ValueError("retrieval settings differ from those of the model")

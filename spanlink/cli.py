"""Command line: `python -m spanlink.cli COMMAND ...`. Tables are Parquet, TSV or CSV by suffix; results are printed as JSON."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .functions.text import normalize_records
from .operators import audit, decision, features, fusion, models
from .plans import baseline, smoke, workflow
from .sources import readers, sinks

#: Packages that nothing here needs, but that a user may plug in as encoder or reranker.
OPTIONAL = ("faiss", "sentence_transformers", "torch", "transformers", "peft")


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("spanlink").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _say(value) -> None:
    print(json.dumps(value, indent=2, sort_keys=True, default=str))


def _write(df: DataFrame, path: str) -> dict:
    sinks.write_shard(df, path)
    return {"output": path, "rows": df.sparkSession.read.parquet(path).count()}


def optional_packages() -> dict[str, bool]:
    return {name: importlib.util.find_spec(name) is not None for name in OPTIONAL}


def doctor(spark, a) -> dict:
    s = readers.load_settings(a.config)
    paths = {}
    for name in ("data_dir", "work_dir", "output_dir"):
        at = folder = s.path(name)
        while not os.path.exists(at):
            at = os.path.dirname(at)
        paths[name] = {"path": folder, "exists": os.path.exists(folder), "disk_free_gib": round(shutil.disk_usage(at).free / 2**30, 2)}
    return baseline.environment(spark) | {"optional_packages": optional_packages(), "executables": {n: shutil.which(n) for n in ("git", "java", "uroman")}, "paths": paths}


def run_smoke(spark, a) -> dict:
    return smoke.run(spark, readers.load_settings(a.config))


def run_baseline(spark, a) -> dict:
    options, out = baseline.Options.load(a.baseline_config), {}
    if a.step in ("audit", "all"):
        out["audit"] = sorted(baseline.run_audit(spark, options))
    if a.step == "index":
        q, t = baseline.sides(spark, options, a.split)
        out["index"] = _write(baseline.blocking.build_index(t, options.composite_blocks), f"{options.work_dir}/artifacts/index_{a.split}.parquet")
    if a.step in ("train", "train-full", "all"):
        out["run"] = baseline.train(spark, options, a.step == "train-full", a.ood, a.ablations)
    if a.step in ("predict", "all"):
        out["submission"] = baseline.predict(spark, options, a.model)
    return out


def prepare_data(spark, a) -> dict:
    return {split: readers.prepare_split(spark, f"{a.data_dir}/{split}", a.output, split) for split in (("train", "test") if a.split == "both" else (a.split,))}


def generate_candidates(spark, a) -> dict:
    s = readers.load_settings(a.config)
    low, high = s.get("candidates.sparse.ngram_range", [2, 5])
    sides = [normalize_records(_keyed(readers.read_frame(spark, path), key)) for path, key in ((a.queries, "q"), (a.targets, "t"))]
    out = workflow.generate_candidates(*sides, top_k=int(s.get("candidates.sparse.top_k", 120)), final_cap=int(s.get("candidates.final_cap", 250)), rrf_k=int(s.get("candidates.rrf_k", 60)), low=low, high=high)
    return _write(out, f"{a.output}/candidates.parquet")


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df if key in df.columns else df.withColumnRenamed("entity_id", key)


def fuse(spark, a) -> dict:
    return _write(fusion.fuse_candidates([readers.read_frame(spark, p) for p in a.inputs], a.top_k, int(a.rrf_k), per_source_cap=a.per_source_cap), a.output)


def normalize(spark, a) -> dict:
    df = readers.read_frame(spark, a.input)
    features.require_unique(df, a.id_column)
    return _write(normalize_records(df, extras=True), a.output)


def build_features(spark, a) -> dict:
    pairs, q, t = (readers.read_frame(spark, p) for p in (a.pairs, a.queries, a.targets))
    return _write(features.build_pair_features(pairs, q.withColumnRenamed(a.query_id, "q"), t.withColumnRenamed(a.target_id, "t")), a.output)


def label_features(spark, a) -> dict:
    df = features.attach_labels(readers.read_frame(spark, a.features), readers.read_frame(spark, a.truth))
    return _write(decision.assign_group_folds(df, folds=a.folds, seed=a.seed), a.output)


def mine_negatives(spark, a) -> dict:
    return _write(decision.mine_hard_negatives(readers.read_frame(spark, a.pairs), a.per_query, a.per_target, a.score_floor), a.output)


def train_ensemble(spark, a) -> dict:
    s = readers.load_settings(a.config)
    df = readers.read_frame(spark, a.features)
    params = models.tree_params({"rounds": s.get("gbdt.rounds", 40), "seed": s.get("seed", 42)} | (s.get("gbdt.params") or {}))
    folds = df.agg(F.max("fold")).first()[0] + 1
    ensemble = models.train_cross_fitted(df, folds, params=params)
    ensemble.save(a.output)
    return _write(ensemble.oof.select("q", "t", "fold", "label", "score"), f"{a.output}/oof.parquet") | {"folds": folds, "features": len(ensemble.features)}


def score_ensemble(spark, a) -> dict:
    scored = models.Ensemble.load(spark, a.model_dir).predict(readers.read_frame(spark, a.features), a.full_model)
    return _write(scored.select("q", "t", "score"), a.output)


def decode(spark, a) -> dict:
    scores, queries = readers.read_frame(spark, a.scores), readers.read_frame(spark, a.queries).withColumnRenamed(a.query_column, "q")
    chosen = decision.decode_pairs(scores, a.strategy, a.threshold, a.beta, a.k_max).where("selected")
    sinks.write_submission(queries.select("q"), chosen, scores, a.output)
    return {"matching": f"{a.output}/matching_results.tsv", "candidate": f"{a.output}/candidate_pairs.tsv", "links": chosen.count()}


def validate(spark, a) -> dict:
    ids = lambda n, key: readers.read_tsv(spark, f"{a.test_dir}/test_source{n}.tsv").select(F.col("entity_id").alias(key))
    known = ids(2, "t").unionByName(ids(3, "t")) if a.check_ids else None
    candidate = a.candidate if a.candidate and os.path.exists(a.candidate) else None
    valid, problems = audit.validate_submission(spark, a.matching, ids(1, "q"), candidate, known)
    return {"valid": valid, "problems": [r.asDict() for r in problems.collect()], "candidate_checked": candidate is not None, "ids_checked": a.check_ids}


CONFIG = ("--config", {"default": None})
#: command: (function, what it does, options)
COMMANDS = {
    "doctor": (doctor, "check packages, paths and the session", [CONFIG]),
    "smoke": (run_smoke, "run every stage on twelve built-in records", [CONFIG]),
    "baseline": (run_baseline, "audit, index, train, predict by the classical baseline", [
        ("step", {"choices": ["audit", "index", "train", "train-full", "predict", "all"]}), ("--config", {"dest": "baseline_config", "default": "configs/baseline.yaml"}), ("--split", {"default": "train", "choices": ["train", "test"]}),
        ("--model", {}), ("--ood", {"action": "store_true"}), ("--ablations", {"action": "store_true"})]),
    "prepare-data": (prepare_data, "record TSVs to Parquet", [("--data-dir", {"default": "dataset"}), ("--output", {"default": "artifacts/data"}), ("--split", {"default": "both", "choices": ["train", "test", "both"]})]),
    "generate-candidates": (generate_candidates, "exact and sparse retrieval, fused", [("--queries", {"required": True}), ("--targets", {"required": True}), ("--output", {"required": True}), CONFIG]),
    "fuse-candidates": (fuse, "reciprocal-rank fusion of candidate tables", [("--inputs", {"nargs": "+", "required": True}), ("--output", {"required": True}), ("--top-k", {"type": int, "required": True}), ("--rrf-k", {"type": float, "default": 60.0}), ("--per-source-cap", {"type": int})]),
    "normalize": (normalize, "add native and romanised views", [("--input", {"required": True}), ("--output", {"required": True}), ("--id-column", {"required": True})]),
    "build-features": (build_features, "features of candidate pairs", [("--pairs", {"required": True}), ("--queries", {"required": True}), ("--targets", {"required": True}), ("--output", {"required": True}), ("--query-id", {"default": "q"}), ("--target-id", {"default": "t"})]),
    "label-features": (label_features, "labels and folds by query", [("--features", {"required": True}), ("--truth", {"required": True}), ("--output", {"required": True}), ("--folds", {"type": int, "default": 5}), ("--seed", {"type": int, "default": 42})]),
    "mine-negatives": (mine_negatives, "hard negatives of scored pairs", [("--pairs", {"required": True}), ("--output", {"required": True}), ("--per-query", {"type": int, "default": 10}), ("--per-target", {"type": int, "default": 3}), ("--score-floor", {"type": float, "default": 0.01})]),
    "train-ensemble": (train_ensemble, "cross-fitted trees", [("--features", {"required": True}), ("--output", {"required": True}), CONFIG]),
    "score-ensemble": (score_ensemble, "scores of a saved ensemble", [("--features", {"required": True}), ("--model-dir", {"required": True}), ("--output", {"required": True}), ("--full-model", {"action": "store_true"})]),
    "decode": (decode, "decisions and submission files", [("--scores", {"required": True}), ("--queries", {"required": True}), ("--output", {"required": True}), ("--strategy", {"default": "expected_f_exclusive", "choices": decision.STRATEGIES}), ("--threshold", {"type": float, "default": 0.7}), ("--beta", {"type": float, "default": 0.5}), ("--k-max", {"type": int, "default": 25}), ("--query-column", {"default": "q"})]),
    "validate": (validate, "check submission files", [("--matching", {"required": True}), ("--candidate", {}), ("--test-dir", {"required": True}), ("--check-ids", {"action": "store_true"})]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanlink", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, what, options) in COMMANDS.items():
        one = commands.add_parser(name, help=what)
        for option, how in options:
            one.add_argument(option, **how)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    result = COMMANDS[a.command][0](spark or _session(), a)
    _say(result)
    return 0 if result.get("valid", True) else 1


if __name__ == "__main__":
    sys.exit(main())

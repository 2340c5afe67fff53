"""Every stage on the built-in records: candidates, features, cross-fitted trees, decisions, submission files and their checks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..functions.text import normalize_records
from ..operators import audit, blocking, decision, evaluation, features, fusion, models, sparse
from ..sources import readers, sinks


def run(spark: SparkSession, settings: readers.Settings) -> dict:
    """Metrics of the smoke records; files go to the settings' work and output folders."""
    work, output = settings.path("work_dir"), settings.path("output_dir")
    os.makedirs(work, exist_ok=True)
    os.makedirs(output, exist_ok=True)
    with sinks.stage_manifest(f"{work}/smoke.manifest.json", "smoke", settings.values) as record:
        queries, targets, truth = readers.smoke_records(spark)
        q, t = normalize_records(queries), normalize_records(targets)
        idf, postings = sparse.fit(t, "t", "combined_roman", 2, 4, 1, 10_000)
        found = [blocking.exact_candidates(q, t, ["phone_norm"]), sparse.search(q, "q", "combined_roman", idf, postings, 5, "sparse", 2, 4)]
        sinks.write_shard(fusion.fuse_candidates(found, 6, 30), f"{work}/candidates.parquet")
        candidates = spark.read.parquet(f"{work}/candidates.parquet")
        labelled = features.attach_labels(features.build_pair_features(candidates, q, t), truth)
        folds = int(settings.get("validation.folds"))
        sinks.write_shard(decision.assign_group_folds(labelled, folds=folds, seed=int(settings.get("seed", 42))), f"{work}/features.parquet")
        pairs = spark.read.parquet(f"{work}/features.parquet")
        params = models.tree_params({"rounds": min(20, int(settings.get("gbdt.rounds", 20)))} | (settings.get("gbdt.params") or {}))
        params |= {"minInstancesPerNode": 1, "maxDepth": min(3, params.get("maxDepth", 3))}  # 72 pairs in all
        ensemble = models.train_cross_fitted(pairs, folds, params=params)
        ensemble.save(f"{work}/models")
        scored = models.Ensemble.load(spark, f"{work}/models").predict(pairs, use_full=True).select("q", "t", "score")
        decoder = {k: settings.get(f"decoder.{k}") for k in ("strategy", "threshold", "k_max", "extra_miss")}
        chosen = decision.decode_pairs(scored, beta=float(settings.get("validation.beta", 0.5)), **decoder).where("selected")
        sinks.write_submission(queries.select("q"), chosen, scored, output)
        valid, problems = audit.validate_submission(spark, f"{output}/matching_results.tsv", queries.select("q"), f"{output}/candidate_pairs.tsv", targets.select("t"))
        metrics = evaluation.evaluate_sets(queries, truth, chosen, candidates).first().asDict()
        summary = {"metrics": metrics, "candidates": candidates.count(), "features": len(ensemble.features), "validator_passed": valid, "problems": [r.asDict() for r in problems.collect()]}
        sinks.atomic_json(summary, f"{work}/smoke-summary.json")
        record["outputs"] = {p: sinks.file_fingerprint(p) for p in (f"{output}/matching_results.tsv", f"{output}/candidate_pairs.tsv", f"{work}/smoke-summary.json")}
    return summary

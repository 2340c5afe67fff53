"""The classical baseline from record files to a submission: audit, features, training with reports, restartable prediction.

Everything that grows with the records stays in DataFrames: blocking, features and scores are written as Parquet once and read
by all later steps. The driver sees one row of metrics, thresholds, or a report at a time.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import platform
import time
from dataclasses import asdict, dataclass, field, fields
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prepare
from ..operators import audit, blocking, decision, evaluation, features, models, sparse
from ..sources import readers, sinks

VIEWS = ("name", "address")
TFIDF = ("name_tfidf", "address_tfidf", "combined_tfidf")
#: Feature families that an ablation leaves out, by the beginnings of their names.
ABLATIONS = {"no_address": ("address_", "numeric_", "postal_"), "no_name": ("name_", "core_", "acronym_", "unicode_name"), "no_numeric": ("numeric_", "postal_"), "no_retrieval": ("retrieval_", "rank_", "block_")}
#: Options that a model's candidates depend on: prediction refuses others.
FROZEN = ("block_limit", "prefilter_k", "top_k", "ngram_range", "tfidf_max_features", "composite_blocks")


@dataclass
class Options:
    data_dir: str = "dataset"
    work_dir: str = "work/baseline"
    output_dir: str = "output"
    seed: int = 42
    sample_entities: int = 50_000
    full_eval_entities: int = 50_000
    block_limit: int = 100
    composite_blocks: bool = True
    prefilter_k: int = 30
    top_k: int = 15
    ngram_range: tuple[int, int] = (3, 5)
    tfidf_sample: int = 80_000
    tfidf_max_features: int = 200_000
    hard_negatives_per_entity: int = 5
    part_entities: int = 200_000
    model: dict = field(default_factory=dict)
    threshold_grid: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.975, 0.99)

    @classmethod
    def load(cls, path: str, **over) -> Options:
        """From a YAML file; keys that Spark has no use for (threads, chunk sizes) are passed over, tree settings are translated."""
        import yaml

        known = {f.name for f in fields(cls)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in (yaml.safe_load(Path(path).read_text()) or {}).items() if k in known}
        out = cls(**(values | over))
        out.model = models.tree_params(out.model)
        return out


def fit_views(targets: DataFrame, options: Options) -> dict[str, DataFrame]:
    """(term, idf) of the name and address views, from a seeded sample of the targets."""
    sample = readers.sample_rows(targets.select("t", *VIEWS), "t", options.tfidf_sample, options.seed)
    n = min(options.tfidf_sample, targets.count())
    low, high = options.ngram_range
    return {v: sparse.fit_idf(sparse.term_counts(sample, "t", v, low, high), n + 1, 1, options.tfidf_max_features) for v in VIEWS}


def batch_features(queries: DataFrame, targets: DataFrame, views: dict[str, DataFrame], options: Options) -> DataFrame:
    """Candidate pairs of prepared records with lexical and TF-IDF features: the union of each TF-IDF view's top k and of exact pairs."""
    index = blocking.build_index(targets, options.composite_blocks, check=False)
    met = blocking.block_candidates(queries, index, options.block_limit, options.composite_blocks)
    met = met.join(features.lexical_side(queries, "q"), "q").join(features.lexical_side(targets, "t"), "t")
    pairs = sinks.stored(blocking.prefilter_columns(sinks.stored(met, "met"), options.prefilter_k).drop("exact", "truncated"), "pairs")
    low, high = options.ngram_range
    out = pairs
    for v, idf in views.items():
        out = sparse.text_cosine(out, f"q_{v}", f"t_{v}", idf, f"{v}_tfidf", low, high, True, kinds=pairs)
    out = out.select(*pairs.columns, *[f"{v}_tfidf" for v in views]).withColumn("combined_tfidf", (F.col("name_tfidf") + F.col("address_tfidf")) / 2)
    lexical = features.lexical_columns(out, options.composite_blocks, kinds=pairs)
    return final_candidates(lexical, options.top_k)


def final_candidates(df: DataFrame, k: int, views: tuple[str, ...] = TFIDF, exact: bool = True) -> DataFrame:
    both = (F.col("name_exact") == 1) & (F.col("address_exact") == 1)
    kept = blocking.top_by_views(df.withColumn("__exact", both), k, views, "", "__exact" if exact else None)
    return kept.drop("__exact", *[f"rank_{v}" for v in views])


def sides(spark: SparkSession, options: Options, split: str) -> tuple[DataFrame, DataFrame]:
    """Prepared queries (source 1) and targets (sources 2 and 3) of a split's files."""
    folder = f"{options.data_dir}/{split}"
    q = readers.read_records(spark, folder, split, (1,)).withColumnRenamed("entity_id", "q")
    t = readers.read_records(spark, folder, split, (2, 3)).withColumnRenamed("entity_id", "t")
    return prepare(q), prepare(t)


def _stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at path; a finished table that is there is read and not made again."""
    if not Path(path, "_SUCCESS").exists():
        sinks.write_shard(df, path)
    return spark.read.parquet(path)


def _digest(*values) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _inputs(options: Options, split: str) -> list:
    folder = Path(options.data_dir, split)
    return [(p.name, sinks.file_fingerprint(str(p))) for p in sorted(folder.glob("*.tsv"))]


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


class Training:
    """One training run: features of the sampled (or all) entities, the choice of a threshold, reports and the final model."""

    def __init__(self, spark: SparkSession, options: Options, full: bool = False) -> None:
        self.spark, self.options, self.full = spark, options, full
        self.key = _digest(3, full, {k: v for k, v in asdict(options).items() if k not in ("output_dir", "work_dir", "model", "threshold_grid")}, _inputs(options, "train"))
        self.store = f"{options.work_dir}/artifacts/features_{self.key}"
        self.run_id = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()) + f"-{os.getpid()}"
        self.out = f"{options.work_dir}/artifacts/{self.run_id}"
        self.reports = f"{options.work_dir}/reports"
        Path(self.out, "reports").mkdir(parents=True)
        Path(self.reports).mkdir(parents=True, exist_ok=True)

    def prepare(self) -> None:
        o, spark = self.options, self.spark
        queries, self.targets = sides(spark, o, "train")
        truth = readers.truth_to_pairs(readers.read_truth(spark, f"{o.data_dir}/train/train_ground_truth.tsv"))
        if self.full:  # all entities; only those of the evaluation sample calibrate and test
            n = queries.count()
            chosen = queries.withColumn("split", decision.evaluation_role(F.col("q"), n, o.full_eval_entities, o.seed))
        else:
            chosen = decision.sample_entities(queries, "q", o.sample_entities, o.seed)
        self.queries = _stored(spark, chosen, f"{self.store}/queries")
        self.targets = _stored(spark, self.targets, f"{self.store}/targets")
        self.truth = _stored(spark, truth.join(self.queries.select("q"), "q", "left_semi"), f"{self.store}/truth")
        self.views = {v: _stored(spark, idf, f"{self.store}/idf_{v}") for v, idf in fit_views(self.targets, o).items()}
        broad = batch_features(self.queries, self.targets, self.views, Options(**(asdict(o) | {"top_k": max(15, o.top_k)})))
        broad = features.attach_labels(broad, self.truth).join(self.queries.select("q", "split", "country"), "q")
        if self.full:
            broad = features.select_training_rows(broad, o.hard_negatives_per_entity)
        self.broad = _stored(spark, broad, f"{self.store}/pairs")
        self.frame = _stored(spark, final_candidates(self.broad, o.top_k), f"{self.out}/candidate_features")
        self.columns = [c for c in features.numeric_columns(self.frame) if c not in ("block_mask", "label")]

    def of(self, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(queries, truth, candidate features) of a split."""
        q = self.queries.where(F.col("split") == split)
        return q, self.truth.join(q.select("q"), "q", "left_semi"), self.frame.where(F.col("split") == split)

    def tuned(self, fit: DataFrame, cal: DataFrame, cal_truth: DataFrame, cal_queries: DataFrame, columns: list[str]):
        """(model, threshold) fitted on one table and tuned on another."""
        model = models.fit_trees(fit, columns, self.options.model)
        scored = models.score_trees(cal, model, columns).select("q", "t", "score")
        return model, decision.tune_threshold(scored, cal_truth, list(self.options.threshold_grid), cal_queries)

    def metrics(self, queries: DataFrame, truth: DataFrame, scored: DataFrame, threshold: float, prefix: str = "") -> dict:
        mine = lambda df: df.join(queries.select("q"), "q", "left_semi").where(F.col("t").startswith(prefix)).select("q", "t")
        return _row(evaluation.evaluate(queries, mine(truth), mine(scored.where(F.col("score") >= threshold)), mine(scored), check=False))

    def report(self, name: str, title: str, value) -> None:
        for folder in (f"{self.out}/reports", self.reports):
            sinks.markdown_report(title, value, f"{folder}/{name}.md")

    def table(self, name: str, rows: list[dict]) -> None:
        for folder in (f"{self.out}/reports", self.reports):
            sinks.csv_rows(rows, f"{folder}/{name}.csv")

    def log(self, experiment: str, split: str, metrics: dict, threshold, note: str) -> None:
        sinks.record_experiment(f"{self.options.work_dir}/experiments/experiments.jsonl", {"run_id": self.run_id, "experiment": experiment, "split": split, "threshold": threshold, "note": note, "metrics": metrics})

    def retrieval(self) -> None:
        q, truth, _ = self.of("calibration")
        cal = self.broad.where("split = 'calibration'").withColumn("exact", (F.col("name_exact") == 1) & (F.col("address_exact") == 1))
        ranked = blocking.top_by_views(cal.drop("rank_name", "rank_address", "rank_combined"), 10**6, TFIDF, "", None)
        rows = evaluation.retrieval_benchmark(ranked, truth, q, self.targets.count(), TFIDF).orderBy("view", "k").collect()  # a row a view and k
        self.table("candidate_recall_vs_k", [{**r.asDict(), "quantiles": list(r["quantiles"]), "by_country": dict(r["by_country"])} for r in rows])
        for r in rows:
            self.log("E002", "calibration", {"recall": r["recall"], "mean_candidates": r["mean_candidates"]}, None, f"candidate budget {r['view']} {r['k']}")

    def out_of_country(self) -> list[dict]:
        """Trained and tuned on one country, tested on the others."""
        _, _, fit = self.of("fit")
        (cal_q, cal_truth, cal), (hold_q, hold_truth, hold) = self.of("calibration"), self.of("holdout")
        found = []
        for country in sorted(r[0] for r in fit.select("country").distinct().collect()):  # countries
            only, others = F.col("country") == country, F.col("country") != country
            q = cal_q.where(only)
            model, (threshold, _) = self.tuned(fit.where(only), cal.where(only), cal_truth.join(q.select("q"), "q", "left_semi"), q, self.columns)
            met = self.metrics(hold_q.where(others), hold_truth, models.score_trees(hold.where(others), model, self.columns), threshold)
            found.append({"trained_country": country, "threshold": threshold, **met})
            self.log("E007", "country_holdout", met, threshold, f"train and calibrate {country}, test the others")
        self.table("country_ood", found)
        return found

    def ablations(self) -> list[dict]:
        """Without a family of features each."""
        (_, _, fit), (cal_q, cal_truth, cal), (hold_q, hold_truth, hold) = (self.of(s) for s in ("fit", "calibration", "holdout"))
        found = []
        for label, family in ABLATIONS.items():
            columns = [c for c in self.columns if not c.startswith(family)]
            model, (threshold, _) = self.tuned(fit, cal, cal_truth, cal_q, columns)
            met = self.metrics(hold_q, hold_truth, models.score_trees(hold, model, columns), threshold)
            found.append({"ablation": label, "threshold": threshold, **met})
            self.log("E003A", "holdout", met, threshold, f"ablation {label}")
        self.table("ablations", found)
        return found

    def run(self, ood: bool = False, ablations: bool = False) -> str:
        o, began = self.options, time.time()
        sinks.atomic_json(asdict(o), f"{self.out}/config.json")
        sinks.atomic_json(environment(self.spark), f"{self.out}/environment.json")
        self.prepare()
        names = self.queries.select("q", *blocking_fields()), self.targets.select("t", *blocking_fields())
        self.report("exact_match_statistics", "Exact-match coverage", [r.asDict() for r in evaluation.link_coverage(self.truth, *names).collect()])  # a row a field
        if not self.full:
            self.retrieval()
        (_, _, fit), (cal_q, cal_truth, cal), (hold_q, hold_truth, hold) = (self.of(s) for s in ("fit", "calibration", "holdout"))
        exact = hold.where("name_exact = 1 and address_exact = 1 and same_country = 1")
        v0 = {"all_empty": _row(evaluation.evaluate(hold_q, hold_truth, exact.where("false"), hold, check=False)), "normalized_name_address_country": _row(evaluation.evaluate(hold_q, hold_truth, exact, hold, check=False))}
        self.report("v0_results", "V0 holdout baselines", v0)
        for name, met in v0.items():
            self.log("E000" if name == "all_empty" else "E001", "holdout", met, None, name)
        model, (threshold, _) = self.tuned(fit, cal, cal_truth, cal_q, self.columns)
        curve = decision.threshold_table(models.score_trees(cal, model, self.columns), cal_truth, list(o.threshold_grid), cal_q).orderBy("threshold").collect()
        self.table("threshold_curve", [r.asDict() for r in curve])
        scored = _stored(self.spark, models.score_trees(hold, model, self.columns), f"{self.out}/holdout_predictions")
        predicted = scored.where(F.col("score") >= threshold)
        details = {"run_id": self.run_id, "threshold": threshold, "features": len(self.columns), "holdout": self.metrics(hold_q, hold_truth, scored, threshold), "fixed_threshold": self.metrics(hold_q, hold_truth, scored, 0.5)}
        countries = sorted(r[0] for r in hold_q.select("country").distinct().collect())  # countries
        details["by_country"] = {c: self.metrics(hold_q.where(F.col("country") == c), hold_truth, scored, threshold) for c in countries}
        details["by_source"] = {s: self.metrics(hold_q, hold_truth, scored, threshold, s) for s in ("S2-", "S3-")}
        details["errors"] = {r["kind"]: r["count"] for r in evaluation.error_kinds(hold_q, self.targets, hold_truth, predicted, scored).collect()}  # a row a kind
        importance = sorted(zip(self.columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
        self.table("feature_importance", [{"feature": n, "importance": v} for n, v in importance])
        self.log("E003", "holdout", details["fixed_threshold"], 0.5, "hard negatives")
        self.log("E004", "holdout", details["holdout"], threshold, "tuned on the calibration entities")
        if ood:
            details["ood"] = self.out_of_country()
        if ablations:
            details["ablations"] = self.ablations()
        final = models.fit_trees(self.frame, self.columns, o.model)  # the policy is settled: all labelled entities
        final.write().overwrite().save(f"{self.out}/model")
        for v, idf in self.views.items():
            sinks.write_shard(idf, f"{self.out}/idf_{v}")
        details["training_wall_seconds"] = time.time() - began
        self.report("v1_results", "V1 validation results", details)
        sinks.atomic_json(details, f"{self.out}/metrics.json")
        sinks.atomic_json({"columns": self.columns, "threshold": threshold, "options": asdict(o), "run_id": self.run_id, "features": self.key}, f"{self.out}/bundle.json")
        sinks.atomic_json(self.out, f"{o.work_dir}/artifacts/latest_run.json")
        return self.out


def blocking_fields() -> tuple[str, ...]:
    return ("name", "address", "core", "digits", "country")


def environment(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "logical_cpus": os.cpu_count()}


def train(spark: SparkSession, options: Options, full: bool = False, ood: bool = False, ablations: bool = False) -> str:
    """Folder of the trained run."""
    return Training(spark, options, full).run(ood, ablations)


def predict(spark: SparkSession, options: Options, run: str | None = None) -> str:
    """Submission files of the test split. Queries go in parts of about part_entities; a finished part is not made again."""
    run = run or json.loads(Path(options.work_dir, "artifacts/latest_run.json").read_text())
    bundle = json.loads(Path(run, "bundle.json").read_text())
    for name in FROZEN:
        if (trained := bundle["options"][name]) != (mine := asdict(options)[name]) and trained != list(mine if isinstance(mine, tuple) else [mine]):
            raise ValueError(f"{name} is {mine!r}, but the model was trained with {trained!r}")
    began = time.time()
    queries, targets = sides(spark, options, "test")
    store = f"{options.work_dir}/artifacts/inference_{_digest(bundle['run_id'], options.part_entities, _inputs(options, 'test'))}"
    queries, targets = _stored(spark, queries, f"{store}/queries"), _stored(spark, targets, f"{store}/targets")
    model, views = models.load_trees(f"{run}/model"), {v: spark.read.parquet(f"{run}/idf_{v}") for v in VIEWS}
    parts = max(1, math.ceil(queries.count() / options.part_entities))
    made = []
    for i in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)
        scored = models.score_trees(batch_features(mine, targets, views, options), model, bundle["columns"]).select("q", "t", "score")
        made.append(_stored(spark, scored, f"{store}/part-{i:05d}"))
    scored = reduce(DataFrame.unionByName, made)
    matches = scored.where(F.col("score") >= bundle["threshold"])
    Path(options.output_dir).mkdir(parents=True, exist_ok=True)
    sinks.write_submission(queries.select("q"), matches, scored, options.output_dir)
    summary = {"rows": queries.count(), "matched_links": matches.count(), "candidate_links": scored.count(), "run_id": bundle["run_id"], "seconds": time.time() - began}
    valid, problems = audit.validate_submission(spark, f"{options.output_dir}/matching_results.tsv", queries.select("q"), f"{options.output_dir}/candidate_pairs.tsv", targets.select("t"))
    found = [r.asDict() for r in problems.collect()]  # a row a rule
    sinks.atomic_json(summary | {"valid": valid, "problems": found}, f"{options.output_dir}/inference_summary.json")
    if not valid or any(r["rule"] == "match is no candidate" for r in found):
        raise RuntimeError(f"the submission breaks its rules: {found}")
    return options.output_dir


def run_audit(spark: SparkSession, options: Options) -> dict:
    """Reports on all record and truth files below data_dir, as JSON and Markdown."""
    report = {}
    for path in sorted(Path(options.data_dir).rglob("*.tsv")):
        df = readers.read_tsv(spark, str(path))
        report[str(path.relative_to(options.data_dir))] = audit.truth_report(df) if "matched_entity_ids" in df.columns else audit.record_report(df)
    folder = Path(options.work_dir, "reports")
    folder.mkdir(parents=True, exist_ok=True)
    sinks.atomic_json(report, f"{folder}/data_audit.json")
    sinks.markdown_sections("Full dataset audit", report, f"{folder}/data_audit.md")
    return report

"""The command line, the smoke run and the baseline flow over files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanlink import cli
from spanlink.operators import audit, evaluation
from spanlink.plans import baseline
from spanlink.sources import readers


def run(spark, capsys, *argv):
    code = cli.main([str(a) for a in argv], spark)
    return code, json.loads(capsys.readouterr().out)


def test_smoke_by_command_line(spark, tmp_path, capsys):
    config = tmp_path / "configs" / "smoke.yaml"
    config.parent.mkdir()
    config.write_text("seed: 42\npaths: {work_dir: work, output_dir: out}\nvalidation: {folds: 3}\ngbdt: {rounds: 5, params: {num_leaves: 7, learning_rate: 0.3}}\ndecoder: {strategy: expected_f_exclusive, threshold: 0.7, k_max: 11}\n")
    code, out = run(spark, capsys, "smoke", "--config", config)
    assert code == 0 and out["validator_passed"] and out["metrics"]["macro_candidate_recall"] == 1.0 and out["metrics"]["macro_fbeta"] == 1.0
    manifest = json.loads((tmp_path / "work/smoke.manifest.json").read_text())
    assert manifest["status"] == "complete" and len(manifest["outputs"]) == 3
    lines = (tmp_path / "out/matching_results.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and "S1-1\tS2-1" in lines
    code, out = run(spark, capsys, "doctor", "--config", config)
    assert code == 0 and out["paths"]["work_dir"]["exists"] and set(out["optional_packages"]) == set(cli.OPTIONAL)


def test_stages_by_command_line(spark, tmp_path, capsys):
    q, t, truth = readers.smoke_records(spark)
    for name, df in (("q", q), ("t", t), ("truth", truth)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    at = lambda name: f"{tmp_path}/{name}.parquet"
    for side in "qt":
        assert run(spark, capsys, "normalize", "--input", at(side), "--output", at(f"{side}n"), "--id-column", side)[1]["rows"] == (12 if side == "q" else 24)
    assert run(spark, capsys, "generate-candidates", "--queries", at("q"), "--targets", at("t"), "--output", tmp_path / "c")[1]["rows"] >= 12
    pairs = f"{tmp_path}/c/candidates.parquet"
    found = spark.read.parquet(pairs).selectExpr("q", "t", "'fused' AS retrieval_source", "fused_rank AS rank", "fused_score AS retrieval_score")
    found.write.parquet(at("one"))
    fused = run(spark, capsys, "fuse-candidates", "--inputs", at("one"), at("one"), "--output", at("two"), "--top-k", 3)[1]
    assert 12 <= fused["rows"] <= 36
    assert run(spark, capsys, "build-features", "--pairs", at("two"), "--queries", at("qn"), "--targets", at("tn"), "--output", at("f"))[1]["rows"] == fused["rows"]
    assert run(spark, capsys, "label-features", "--features", at("f"), "--truth", at("truth"), "--output", at("l"), "--folds", 2)[1]["rows"] == fused["rows"]
    settings = tmp_path / "a" / "s.yaml"
    settings.parent.mkdir()
    settings.write_text("gbdt: {rounds: 2, params: {min_data_in_leaf: 1, num_leaves: 4}}\n")
    trained = run(spark, capsys, "train-ensemble", "--features", at("l"), "--output", tmp_path / "m", "--config", settings)[1]
    assert trained["folds"] == 2 and trained["rows"] == fused["rows"]
    assert run(spark, capsys, "score-ensemble", "--features", at("l"), "--model-dir", tmp_path / "m", "--output", at("s"), "--full-model")[1]["rows"] == fused["rows"]
    oof = spark.read.parquet(f"{tmp_path}/m/oof.parquet")
    oof.write.parquet(at("oof"))
    assert run(spark, capsys, "mine-negatives", "--pairs", at("oof"), "--output", at("n"), "--score-floor", 0)[1]["rows"] >= 1
    out = run(spark, capsys, "decode", "--scores", at("s"), "--queries", at("q"), "--output", tmp_path / "sub", "--strategy", "threshold_exclusive", "--threshold", 0.5)[1]
    assert out["links"] == 12
    for n, df in ((1, q.selectExpr("q AS entity_id")), (2, t.where("t like 'S2%'").selectExpr("t AS entity_id")), (3, t.where("t like 'S3%'").selectExpr("t AS entity_id"))):
        (tmp_path / f"test_source{n}.tsv").write_text("entity_id\n" + "".join(r[0] + "\n" for r in df.collect()))
    code, checked = run(spark, capsys, "validate", "--matching", out["matching"], "--candidate", out["candidate"], "--test-dir", tmp_path, "--check-ids")
    assert code == 0 and checked["valid"] and checked["candidate_checked"]
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tX\nS1-99\tS1-1\n")
    code, checked = run(spark, capsys, "validate", "--matching", bad, "--test-dir", tmp_path)
    assert code == 1 and {r["rule"] for r in checked["problems"]} == {"repeated id", "repeated row", "prefix", "self match", "missing query", "extra query"}


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dataset")
    q, t, truth = (df.collect() for df in readers.smoke_records(spark, 90))
    tsv = lambda rows, key: "entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{r[key]}\t{r['name']}\t{r['address']}\t{r['country']}\n" for r in rows)
    for split in ("train", "test"):
        (root / split).mkdir()
        (root / split / f"{split}_source1.tsv").write_text(tsv(q, "q"))
        for n in (2, 3):
            (root / split / f"{split}_source{n}.tsv").write_text(tsv([r for r in t if r["t"].startswith(f"S{n}-")], "t"))
    true = {r["q"]: r["t"] for r in truth if int(r["q"][3:]) % 5}
    (root / "train/train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{r['q']}\t{true.get(r['q'], '')}\n" for r in q))
    return root


def test_baseline_over_files(spark, dataset, tmp_path, capsys):
    config = tmp_path / "baseline.yaml"
    config.write_text(f"seed: 42\ndata_dir: {dataset}\nwork_dir: {tmp_path}/work\noutput_dir: {tmp_path}/out\nsample_entities: 1000\ntop_k: 3\nthreads: 16\nmodel: {{n_estimators: 3, num_leaves: 7, min_child_samples: 2, learning_rate: 0.3}}\nthreshold_grid: [0.3, 0.5, 0.7]\n")
    assert baseline.Options.load(str(config)).model == {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 2, "stepSize": 0.3}
    assert len(run(spark, capsys, "baseline", "audit", "--config", config)[1]["audit"]) == 7
    report = json.loads((tmp_path / "work/reports/data_audit.json").read_text())
    assert report["train/train_source1.tsv"]["rows"] == 90 and report["train/train_ground_truth.tsv"]["links"] == 72 and report["train/train_ground_truth.tsv"]["match_cardinality"] == {"0": 18, "1": 72}
    folder = Path(run(spark, capsys, "baseline", "train", "--config", config, "--ood", "--ablations")[1]["run"])
    metrics = json.loads((folder / "metrics.json").read_text())
    assert metrics["holdout"]["queries"] > 5 and metrics["holdout"]["micro_candidate_recall"] == 1.0 and set(metrics["by_source"]) == {"S2-", "S3-"} and len(metrics["ood"]) == 3 and len(metrics["ablations"]) == 4
    for name in ("candidate_recall_vs_k.csv", "threshold_curve.csv", "feature_importance.csv", "country_ood.csv", "ablations.csv", "v0_results.md", "v1_results.md", "exact_match_statistics.md"):
        assert (tmp_path / "work/reports" / name).stat().st_size > 0
    out = Path(run(spark, capsys, "baseline", "predict", "--config", config)[1]["submission"])
    summary = json.loads((out / "inference_summary.json").read_text())
    assert summary["rows"] == 90 and summary["valid"] and summary["matched_links"] > 0
    config.write_text(config.read_text().replace("top_k: 3", "top_k: 4"))
    with pytest.raises(ValueError, match="top_k"):
        cli.main(["baseline", "predict", "--config", str(config)], spark)


def test_error_kinds_of_single_links(spark):
    names = {"a": "one", "b": "two", "c": "three", "d": "four"}
    record = "string, name string, address string, core string, country string"
    targets = spark.createDataFrame([(k, n, "5", n, "x") for k, n in names.items()], f"t {record}")
    queries = spark.createDataFrame([("q1", "one", "5", "one", "x"), ("q2", "two", "6", "two", "y"), ("q3", "three", "5", "three", "x")], f"q {record}")
    pairs = lambda *p: spark.createDataFrame(list(p), "q string, t string")
    truth, predicted = pairs(("q1", "a"), ("q3", "c"), ("q3", "d")), pairs(("q1", "b"), ("q2", "a"), ("q2", "b"))
    kinds = {r["kind"]: r["count"] for r in evaluation.error_kinds(queries, targets, truth, predicted, predicted).collect()}
    assert kinds == {"false_singleton": 1, "false_merge_singleton": 1, "false_positive": 3, "blocking_failure": 3, "exact_name": 3, "exact_address": 4, "number_mismatch": 2, "country_mismatch": 2}
    with pytest.raises(Exception, match="unknown target"):
        evaluation.error_kinds(queries, targets, pairs(("q1", "z")), predicted, predicted).collect()


def test_audit_reports(spark):
    df = spark.createDataFrame([("S1-1", "Café 12", "a b", "FR"), ("S1-2", "", "c", "FR"), ("S1-2", "x", "c d e", "DE")], "entity_id string, business_name string, business_address string, country string")
    r = audit.record_report(df)
    assert (r["rows"], r["keys"], r["repeated_keys"], r["country"], r["missing"]["business_name"]) == (3, 2, 1, {"FR": 2, "DE": 1}, 1)
    assert r["non_ascii_characters"] == [{"char": "é", "code": 233, "rows": 1, "name": "LATIN SMALL LETTER E WITH ACUTE"}] and r["text"]["business_address"]["token_quantiles"]["1.0"] == 3
    truth = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "S2-1"), ("S1-3", "")], "source1_entity_id string, matched_entity_ids string")
    r = audit.truth_report(truth)
    assert (r["links"], r["both_sources"], r["s2_links"], r["s3_links"], r["match_cardinality"], r["max_target_frequency"]) == (3, 1, 2, 1, {0: 1, 1: 1, 2: 1}, 2)
    with pytest.raises(ValueError, match="repeated"):
        audit.truth_report(spark.createDataFrame([("S1-1", "S2-1,S2-1")], truth.schema))
    with pytest.raises(ValueError, match="form"):
        audit.record_report(df.withColumn("entity_id", df.country))


def test_error_kinds_by_rule_are_those_of_the_pairs(spark):
    names, streets = ("red ring", "ring red", "old bolt", "old bolt ltd"), ("1 a", "1 b", "2 a")
    rows = [(k, k % 4 if k % 19 else None, names[k * 7 // 5 % 4], streets[k % 3], names[k * 7 // 5 % 4].removesuffix(" ltd"), "xyz"[k % 5 % 3] if k % 17 else None) for k in range(160)]
    r = spark.createDataFrame(rows, "k long, size long, name string, address string, core string, country string")
    q, t = r.where("k % 3 = 0").withColumn("q", F.col("k").cast("string")), r.where("k % 3 <> 0 and size > 0").withColumn("t", F.col("k").cast("string"))
    met = q.select("q", "size", F.col("k").alias("a")).join(t.select("t", "size", F.col("k").alias("b")), "size")
    rules = ("(a7 + b7) % 3 = 0 and a2 = 0", "(a7 + b7) % 7 < 2 and a4 <> 3", "b2 = 1")
    facts = {"a7": "k % 7", "a2": "k % 2", "a4": "k % 4"}, {"b7": "k % 7", "b2": "k % 2"}
    pairs = [met.where(e).select("q", "t") for e in ("(a % 7 + b % 7) % 3 = 0 and a % 2 = 0", "(a % 7 + b % 7) % 7 < 2 and a % 4 <> 3", "b % 2 = 1")]
    got = {x["kind"]: x["count"] for x in evaluation.error_kinds_by_rule(q, t, "size", *rules, *facts).collect()}
    assert got == {x["kind"]: x["count"] for x in evaluation.error_kinds(q, t, *pairs).collect()} and {*got} >= {"reordered_tokens", "legal_suffix", "multi_match_partial"}


def test_link_coverage_by_key_is_that_of_the_links(spark):
    rows = [(i, (None, "red", "old", "new")[i % 4], ("", "1 a", None, "2 b")[i // 4 % 4], (None, "x", "y", "")[i // 3 % 4]) for i in range(90)]
    r = spark.createDataFrame(rows, "i long, name string, address string, country string")
    q, t = r.where("i % 3 = 0").withColumnRenamed("i", "q"), r.where("i % 3 <> 0").withColumnRenamed("i", "t")
    fields = ("name", "address", "country")
    links = q.select("q", "name").join(t.select("t", "name"), "name").select("q", "t")
    shown = lambda df: {x["field"]: (round(x["share"], 12), x["links"]) for x in df.collect()}
    assert shown(evaluation.link_coverage_by_key(q, t, "name", fields)) == shown(evaluation.link_coverage(links, q, t, fields))
    assert [x["links"] for x in evaluation.link_coverage_by_key(q, t.limit(0), "name", fields).collect()] == [0] * 4

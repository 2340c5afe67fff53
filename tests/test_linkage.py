import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlink.functions import similarity as S
from spanlink.functions import text as X
from spanlink.operators import audit, blocking, decision, dense, evaluation, features, fusion, models, sparse
from spanlink.plans import workflow
from spanlink.sources import readers, sinks


def values(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def one(spark, text, *exprs):
    return tuple(spark.createDataFrame([(text,)], "v string").select(*[e(F.col("v")).alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def test_normalisation(spark):
    assert one(spark, " ÉCOLE & Co. ", X.basic) == ("école and co",)
    assert one(spark, "École", X.accent_fold) == ("ecole",)
    assert one(spark, "Acme Pvt. Ltd.", lambda v: X.aggressive(X.basic(v))) == ("acme",)
    assert one(spark, "12B, 560001; 12", X.numbers) == (["12", "560001"],)
    assert one(spark, None, X.basic, X.normalize_native, X.script_group) == ("", "", "unknown")
    assert one(spark, "NaN", X.basic, X.normalize_native) == ("", "nan")
    assert one(spark, "श्री गणेश", X.script_group)[0] == "devanagari"
    assert one(spark, "श्री abc abc", X.script_group)[0] == "mixed_latin"
    assert "ganesh" in one(spark, "गणेश", X.romanize)[0]
    assert one(spark, "Émile Co", X.text_variants)[0] == ["émile co", "emile co", "emileco"]
    with pytest.raises(ValueError):
        X.romanize(F.lit("a"), "other")


def test_stable_hash():
    assert X.hash_text("split:42:S1-1") == 320456253410137091


def test_similarities():
    assert S.ratio("abcd", "abxd") == 0.75 and S.lcs("", "a") == 0
    assert S.token_set_ratio("acme foods", "foods acme ltd") == 1.0
    assert S.token_sort_ratio("b a", "a b") == 1.0
    assert S.partial_ratio("acme", "the acme works") == 1.0
    assert abs(S.jaro_winkler("martha", "marhta") - 0.9611111) < 1e-6
    assert S.weighted_ratio("", "a") == 0.0


def test_lcs_against_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert S.lcs(a, b) == t[-1, -1]


def test_fusion(spark):
    cols = "q string, t string, retrieval_source string, rank int, retrieval_score double"
    a = spark.createDataFrame([("q1", "t1", "a", 1, 0.9), ("q1", "t2", "a", 2, 0.8)], cols)
    b = spark.createDataFrame([("q1", "t2", "b", 1, 0.95), ("q1", "t3", "b", 2, 0.7)], cols)
    out = fusion.fuse_candidates([a, b], 2, 10).orderBy("fused_rank").collect()
    assert len(out) == 2 and out[0]["t"] == "t2" and out[0]["source_count"] == 2 and out[0]["sources"] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.fuse_candidates([spark.createDataFrame([("q", "t", "a", 0, 1.0)], cols)], 2)
    assert fusion.fuse_candidates([a.limit(0)], 2).columns == out[0].__fields__


def test_exclusivity_and_expected_f(spark):
    df = spark.createDataFrame([("q1", "t1", 0.9), ("q1", "t2", 0.1), ("q2", "t1", 0.8)], "q string, t string, score double")
    assert values(decision.apply_exclusivity(df)) == [("q1", "t1", 0.9), ("q1", "t2", 0.1)]
    got = {(r["q"], r["t"]): r["selected"] for r in decision.decode_pairs(df, "expected_f_exclusive").collect()}
    assert got == {("q1", "t1"): True, ("q1", "t2"): False, ("q2", "t1"): False}
    assert decision.decode_pairs(df.limit(0), "expected_f").collect() == []
    with pytest.raises(ValueError):
        decision.decode_pairs(df, "pi_exclusive")
    exists = spark.createDataFrame([("q1", 0.95), ("q2", 0.01)], "q string, existence double")
    assert decision.decode_pairs(df, "pi_exclusive", existence=exists).where("selected").count() >= 1


def test_decoder_takes_more_than_ten(spark):
    df = spark.createDataFrame([("q", f"t{i:02}", 0.99) for i in range(30)], "q string, t string, score double")
    exists = spark.createDataFrame([("q", 1.0)], "q string, existence double")
    for strategy in ("expected_f", "expected_f_exclusive", "pi_exclusive"):
        chosen = decision.decode_pairs(df, strategy, existence=exists).where("selected")
        assert values(chosen, "t") == [(f"t{i:02}",) for i in range(25)]
    assert decision.expected_f_select(df).where("selected").count() == 25
    assert readers.load_settings().get("decoder.k_max") == 25


def test_best_count_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        p = np.sort(rng.random(5))[::-1]
        best, value = 0, float(np.prod(1 - p))
        for k in range(1, 6):
            f = 0.0
            for mask in range(32):
                x = np.array([mask >> i & 1 for i in range(5)])
                tp = x[:k].sum()
                f += np.prod(np.where(x, p, 1 - p)) * 1.25 * tp / (0.25 * x.sum() + k)
            if f > value + 1e-12:
                best, value = k, f
        k, v = decision.best_count(p, 0.0, 0.5)
        assert k == best and math.isclose(v, value, abs_tol=1e-9)


def test_decode_and_submission(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "S2-1", 0.99), ("S1-2", "S2-2", 0.01)], "q string, t string, score double")
    queries = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3)], "q string")
    chosen = decision.decode_pairs(df, "threshold_exclusive", 0.8).where("selected")
    sinks.write_submission(queries, chosen, df, str(tmp_path))
    assert (tmp_path / "matching_results.tsv").read_bytes() == b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\t\n"
    ok, problems = audit.validate_submission(spark, str(tmp_path / "matching_results.tsv"), queries, str(tmp_path / "candidate_pairs.tsv"))
    assert ok and problems.count() == 0
    outside = spark.createDataFrame([("S1-3", "S2-9")], "q string, t string")
    with pytest.raises(ValueError):
        sinks.write_submission(queries, outside, df, str(tmp_path))


def test_hard_negatives_and_ambiguity(spark):
    df = spark.createDataFrame([("a", "x", 0, 0.9), ("a", "y", 0, 0.8), ("b", "x", 0, 0.85)], "q string, t string, label int, score double")
    out = decision.mine_hard_negatives(df, 1, 1)
    assert values(out, "q", "t") == [("a", "x"), ("a", "y"), ("b", "x")]
    assert decision.ambiguous_queries(df, 0.5).count() == 1


def test_metrics(spark):
    T = "q string, t string"
    qs = spark.createDataFrame([("q1",), ("q2",)], "q string")
    truth = spark.createDataFrame([("q1", "t1")], T)
    r = evaluation.evaluate(qs, truth, truth, truth).first()
    assert r["macro_f05"] == 1.0 and r["singleton_accuracy"] == 1.0
    three = spark.createDataFrame([("q", x) for x in ("S2-00047", "S3-00812")], T)
    pred = three.unionByName(spark.createDataFrame([("q", "S2-00193")], T))
    assert math.isclose(evaluation.evaluate(spark.createDataFrame([("q",)], "q string"), three, pred).first()["macro_f05"], 5 / 7)
    with pytest.raises(ValueError):
        evaluation.evaluate(qs, truth, spark.createDataFrame([("other", "t")], T))
    assert evaluation.evaluate_sets(qs, truth, truth.limit(0)).first()["macro_fbeta"] == 0.5


def test_blocking_caps(spark):
    rows = [("S2-1", "Acme Industrial", "20 Other Lane"), ("S2-2", "Beda Outlet", "12 East Avenue"), ("S2-3", "Acme Industry", "12 South Lane"), ("S3-1", "", "")]
    cols = "string, business_name string, business_address string, country string"
    targets = X.prepare(spark.createDataFrame([(*r, "") for r in rows], f"t {cols}"))
    query = X.prepare(spark.createDataFrame([("S1-1", "Acme Industries", "12 North Road", ""), ("S1-2", "", "", "")], f"q {cols}"))
    got = {c: {r["t"] for r in blocking.block_candidates(query, blocking.build_index(targets, c), 1, c).collect()} for c in (False, True)}
    assert "S2-3" not in got[False] and "S2-3" in got[True]
    with pytest.raises(ValueError):
        blocking.build_index(targets.unionByName(targets))


def test_registered_caps(spark, tmp_path):
    from spanlink.plans.queries import QUERIES

    # S1-0 and 130 targets of its name; S1-198 and two targets that share only the 2-gram " y" with it
    rows = [(k, "xo alpha", "Brand#1", "tin", k) for k in range(196) if not k or k % 3] + [(k, "yp", "Kiln", "Zinc", 7) for k in (196, 197)] + [(198, "yq", "Loom", "Opal", 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    names = ("lexical_features", "prefilter_top_k", "generated_candidates")
    lexical, prefiltered, generated = ({(r["q"], r["t"]) for r in QUERIES[n](spark, str(tmp_path)).select("q", "t").collect()} for n in names)
    of = lambda pairs, q: {t for x, t in pairs if x == q}
    assert len(of(lexical, "S1-0")) == 100 and 30 <= len(of(prefiltered, "S1-0")) <= 90
    assert len(of(generated, "S1-0")) == 130 and {"S2-196", "S3-197"} <= of(generated, "S1-198")


def test_exact_candidates_drop_large_blocks(spark):
    q = spark.createDataFrame([("q", "a", "z")], "q string, name string, address string")
    t = spark.createDataFrame([(f"t{i}", "a", "z" if i == 2 else "") for i in range(3)], "t string, name string, address string")
    assert blocking.exact_candidates(q, t, ["name", "address"], 2).select("t", "retrieval_source", "rank").collect() == [("t2", "exact_address", 1)]
    assert blocking.exact_candidates(q, t, ["name", "address"]).count() == 3


def test_sparse_against_numpy(spark):
    texts = ["red apple", "green apple pie", "blue sky", "apple"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    idf, postings = sparse.fit(df, "id", "text", 3, 4, 1, None)
    got = {(r["q"], r["t"]): r["retrieval_score"] for r in sparse.search(df, "id", "text", idf, postings, 4, "s", 3, 4).collect()}
    grams = []
    for t in texts:
        g = []
        for w in t.split():
            w = f" {w} "
            for n in (3, 4):
                if n == 3 or len(w) >= n:
                    g += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
        grams.append(g)
    terms = sorted({x for g in grams for x in g})
    tf = np.array([[g.count(x) for x in terms] for g in grams], float)
    m = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(4):
        for j in range(4):
            assert math.isclose(got.get((str(i), str(j)), 0.0), float(m[i] @ m[j]), abs_tol=1e-9)


def test_dense_and_cells(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(str(i), [float(x) for x in r]) for i, r in enumerate(v)], "id string, vector array<double>")
    u = dense.unit(df)
    exact = dense.exact_top_k(u.limit(5), u, 3)
    assert exact.where("rank = 1 and q = t").count() == 5
    centers = dense.fit_cells(u, 4)
    near = dense.cell_search(u.limit(5), dense.assign_cells(u, centers, 1), centers, 4, 3)
    assert values(exact, "q", "t") == values(near, "q", "t")
    report = dense.recall_report(exact.select("q", "t"), {"ivf": near}).first()
    assert report["recall_ivf"] == report["recall_union"] == 1.0


def test_features(spark):
    cols = "string, business_name string, business_address string, country string"
    q = X.normalize_records(spark.createDataFrame([("S1-1", "श्री गणेश", "12 MG Road", "IN")], f"q {cols}"), extras=True)
    t = X.normalize_records(spark.createDataFrame([("S2-1", "Shri Ganesh", "12, M.G. Road", "IN")], f"t {cols}"))
    r = features.build_pair_features(spark.createDataFrame([("S1-1", "S2-1")], "q string, t string"), q, t).first()
    assert r["address_digit_jaccard"] == 1 and r["same_country"] == 1 and r["name_roman_fuzzy"] > 0.5
    with pytest.raises(ValueError):
        features.build_pair_features(q.select("q"), q.unionByName(q), t)


def test_lexical_feature_count(spark):
    cols = "string, business_name string, business_address string, country string"
    q, t = (X.prepare(spark.createDataFrame([(i, "Acme Foods", "12 North Road", "IN")], f"{k} {cols}")) for k, i in (("q", "S1-1"), ("t", "S3-1")))
    pairs = blocking.prefilter(blocking.block_candidates(q, blocking.build_index(t), 5), q, t, 3)
    out = features.lexical_features(pairs, q, t)
    assert {"name_exact", "block_10", "rank_combined", "source3", "name_strong_address_weak"} <= set(out.columns)
    r = out.first()
    assert r["name_ratio"] == r["address_jaro"] == 1.0 and r["source3"] == 1 and r["block_0"] == 1


def test_training_rows(spark):
    df = spark.createDataFrame([("a", f"t{i}", int(i == 0), "fit", i / 10) for i in range(4)] + [("b", "t0", 0, "holdout", 0.1)], "q string, t string, label int, split string, combined_tfidf double")
    assert values(features.select_training_rows(df, 1), "q", "t") == [("a", "t0"), ("a", "t3"), ("b", "t0")]
    assert features.select_training_rows(df, 0).count() == 2


def test_splits(spark):
    df = spark.createDataFrame([(f"S1-{i}",) for i in range(1000)], "q string")
    a, b = ([r[0] for r in df.select(decision.split_for(F.col("q"), s)).collect()] for s in (42, 43))
    assert set(a) == {"fit", "calibration", "holdout"} and a != b
    assert df.where(decision.sampled(F.col("q"), 10, 10, 1)).count() == 1000
    assert decision.assign_group_folds(df.unionByName(df), folds=3).groupBy("q").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        decision.assign_group_folds(df, folds=1)


def test_sources(spark, tmp_path):
    (tmp_path / "train_source1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""B"""\t\tIN\n')
    for n in (2, 3):
        (tmp_path / f"train_source{n}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{n}-1\tA\t1 Road\t\n")
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\n")
    r = readers.read_records(spark, str(tmp_path), "train", (1,)).first()
    assert r["business_name"] == 'A "B"' and r["business_address"] == ""
    paths = readers.prepare_split(spark, str(tmp_path), str(tmp_path / "out"), "train")
    truth = readers.read_frame(spark, paths["truth"])
    assert readers.read_frame(spark, paths["targets"]).count() == 2 and truth.count() == 2
    with pytest.raises(ValueError):
        readers.read_frame(spark, "x.doc")
    with pytest.raises(Exception, match="repeated id"):
        spark.createDataFrame([("a,a",)], "v string").select(readers.id_list(F.col("v"))).collect()
    with pytest.raises(ValueError):
        readers.load_settings(overrides={"validation": {"folds": 1}})
    assert readers.load_settings().get("retrieval.rrf_k") == 60


def test_manifest_and_logs(spark, tmp_path):
    path = str(tmp_path / "m.json")
    with sinks.stage_manifest(path, "s", {"a": 1}) as m:
        sinks.check_config(m, {"a": 1})
    with pytest.raises(ValueError):
        sinks.check_config(m, {"a": 2})
    with pytest.raises(RuntimeError), sinks.stage_manifest(path, "s", {}):
        raise RuntimeError
    assert '"failed"' in (tmp_path / "m.json").read_text()
    for name in ("x.csv", "x.jsonl"):
        sinks.record_experiment(str(tmp_path / name), {"k": 1})
    df = spark.range(5)
    assert sinks.table_fingerprint(df) == sinks.table_fingerprint(df.orderBy(F.desc("id")))


def test_models(spark, tmp_path):
    rows = [(f"q{i % 20}", f"t{i}", float(i % 2 + (i % 7) / 10), i % 2) for i in range(200)]
    df = decision.assign_group_folds(spark.createDataFrame(rows, "q string, t string, x double, label int"), folds=2)
    m = models.train_cross_fitted(df, 2, ["x"], {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1})
    assert m.oof.count() == 200 and m.predict(df).where("score > 0.5").count() == 100
    fitted = models.ProbabilityCalibrator("platt", 10).fit(m.oof, "fold")
    cal = fitted.predict(m.oof)
    assert cal.where("calibrated between 0 and 1").count() == 200
    fitted.save(f"{tmp_path}/cal")
    again = models.ProbabilityCalibrator.load(spark, f"{tmp_path}/cal").predict(m.oof)
    assert sorted(again.select("t", F.round("calibrated", 9)).collect()) == sorted(cal.select("t", F.round("calibrated", 9)).collect())
    a = evaluation.query_aggregates(m.oof)
    counts = a.select("q", (F.col("n_p50") > 4).cast("int").alias("n_true"))
    fitted = models.QueryModels().fit(a, counts.withColumn("n_true", F.pmod(F.xxhash64("q"), F.lit(2))), {"maxIter": 1, "maxDepth": 1, "minInstancesPerNode": 1})
    fitted.save(f"{tmp_path}/query")
    loaded = models.QueryModels.load(spark, f"{tmp_path}/query")
    assert sorted(loaded.predict(a).collect()) == sorted(fitted.predict(a).collect())
    with pytest.raises(ValueError):
        models.train_cross_fitted(df.withColumn("label", F.lit(1)), 2, ["x"])
    pairs = spark.createDataFrame([("a", "b")] * 5, "query_text string, target_text string")
    assert models.rerank(pairs, lambda a, b: [1.0] * len(a), 2).where("rerank_score = 1").count() == 5


def test_alphabets(spark):
    texts = {"Москва, Щёкино": "moskva shchekino", "Αθήνα": "athina", "شركة ٣٤": "shrkh 34", "Łódź": "lodz"}
    for text, want in texts.items():
        assert one(spark, text, X.romanize) == (want,)


def test_smoke_recall(spark):
    q, t, truth = readers.smoke_records(spark)
    out = workflow.link(q, t, top_k=5, final_cap=10, min_df=1).where("selected")
    r = evaluation.evaluate(q, truth, out.select("q", "t")).first()
    assert r["macro_f05"] == 1.0


def test_streaming_restart(spark, tmp_path):
    from spanlink.streaming.incremental import score_arrivals

    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i in range(2):
        spark.createDataFrame([(f"q{i}",)], "q string").write.mode("append").parquet(source)
        score_arrivals(spark, source, "q string", lambda df: df.withColumn("s", F.length("q")), out, ck, sep=None).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2


def test_audit(spark):
    df = spark.createDataFrame([("S1-1", "é"), ("S1-01", ""), ("S1-1", "é")], "entity_id string, name string")
    r = audit.table_profile(df, "entity_id", ["name"]).first()
    assert (r["rows"], r["repeated_keys"], r["repeated_rows"], r["name_blank"]) == (3, 1, 1, 1)
    assert values(audit.bad_ids(df), "entity_id") == [("S1-01",)]
    assert audit.char_census(df, "name").first()["rows"] == 2
    assert {r["level"]: r["value"] for r in audit.quantiles(audit.histogram(df, F.length("name"))).collect()}[0.5] == 1


def test_entry_without_llm(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['spanlink.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'op1_language_id' not in e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parent.parent)).returncode == 0


def test_equal_texts_are_multiplied_once(spark):
    texts = ["red ring", "red ring", "blue ring", "old plate", None, "red ring"]
    df = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(texts)], "id string, text string")
    idf, postings = sparse.fit(df, "id", "text", 3, 5, 2, None, True)
    assert values(sparse.text_idf(df, "text", 3, 5, 2, None)) == values(idf)
    side = lambda k: df.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text"))
    pairs = side("q").crossJoin(side("t"))
    plain = sparse.pair_cosine(pairs.select("q", "t"), postings, postings, "s").select("q", "t", F.round("s", 9).alias("s"))
    seen = []
    real, sparse.pair_cosine = sparse.pair_cosine, lambda p, *rest: seen.append(p.count()) or real(p, *rest)
    try:
        once = sparse.text_cosine(pairs, "q_text", "t_text", idf, "s", sublinear=True, decimals=9).select("q", "t", "s")
    finally:
        sparse.pair_cosine = real
    assert values(once) == values(plain) and len(values(once)) == 36 and seen == [9]


def test_measures_of_equal_values_are_made_once(spark, monkeypatch):
    cols = "string, business_name string, business_address string, country string"
    names = ["Red Ring", "ring red ltd", "!!", ""]
    rows = [(i, names[i % 4], f"{i % 3} Brand#{i % 2} 1234{i % 2}", "xyz"[i % 3]) for i in range(24)]
    q, t = (X.prepare(spark.createDataFrame([(f"S{s}-{i}", *r) for i, *r in rows], f"{k} {cols}")) for k, s in (("q", 1), ("t", 3)))
    pairs = q.select("q").crossJoin(t.select("t")).withColumn("block_mask", F.lit(9).cast("long"))
    seen = []
    real = features._field_measures
    monkeypatch.setattr(features, "_field_measures", lambda kinds, f: seen.append((f, kinds.count())) or real(kinds, f))
    out = {(r["q"], r["t"]): r for r in features.lexical_features(pairs, q, t).collect()}
    assert seen == [("name", 9), ("address", 36)] and len(out) == 576
    r = out["S1-0", "S3-1"]
    assert r["name_ratio"] == S.ratio("red ring", "ring red ltd") and r["name_jaccard"] == 2 / 3 and r["core_exact"] == r["name_exact"] == 0 and r["same_country"] == 0
    assert r["name_address_product"] == r["name_ratio"] * r["address_ratio"] and r["postal_conflict"] == 1 and r["source3"] == 1 and r["retrieval_count"] == 2
    assert out["S1-2", "S3-2"]["unicode_name_exact"] == 1 and out["S1-3", "S3-3"]["unicode_name_exact"] == 0 and out["S1-3", "S3-3"]["name_missing"] == 1


def test_equal_queries_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["red", "blue", "ring", "plate", "zinc", "x"], rng.integers(1, 4))) for _ in range(60)] + ["lonely", "lonely", "", None]
    df = spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(texts)], "id string, text string")
    q, t = df.withColumnRenamed("id", "q"), df.withColumnRenamed("id", "t")
    shown = lambda out: values(out.select("q", "t", "rank", F.round("retrieval_score", 9)))
    for name, most in (("QUERY_TEXTS", 7), ("TARGET_TEXTS", 5)):
        monkeypatch.setattr(sparse, name, most)
    for k in (1, 4, 100):
        idf, postings = sparse.fit(df, "id", "text", 2, 4, 2)
        assert shown(sparse.search_texts(q, t, "text", k, "s", 2, 4)) == shown(sparse.search(df, "id", "text", idf, postings, k, "s", 2, 4))

    names = ["Red Ring", "red ring", "Été", "blue plate"]
    sides = [spark.createDataFrame([(f"{k}{i}", names[i % 4], "ab"[i % 2]) for i in range(n)], f"{k} string, name string, address string") for k, n in (("q", 40), ("t", 24))]
    q, t = (X.normalize_records(x) for x in sides)
    seen = []
    for name in ("exact_candidates", "search_texts"):
        real = getattr(where := blocking if name == "exact_candidates" else sparse, name)
        monkeypatch.setattr(where, name, lambda q, *rest, real=real: seen.append(q.count()) or real(q, *rest))
    out = workflow.generate_candidates(q, t, 5, 20, min_df=1)
    assert seen == [4] * 4 and out.groupBy("q").count().count() == 40
    of = lambda k: sorted((r["t"], r["fused_rank"], r["source_count"]) for r in out.where(F.col("q") == k).collect())
    assert of("q2") == of("q38") and {x for x, *_ in of("q2")} >= {"t2", "t6"}


def test_batch_pairs_of_equal_queries(spark, tmp_path, monkeypatch):
    from spanlink.plans import baseline, record_queries
    from spanlink.plans.queries import sides

    rows = [(k, ("red ring", "Blue plate")[k // 3 % 2], f"Brand#{k // 6 % 2}", "tin", k // 3 % 2) for k in range(72)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    q, t = (X.prepare(x) for x in sides(spark, str(tmp_path)))
    met = blocking.block_candidates(q, blocking.build_index(t), 100).join(q.select("q", "name", "address"), "q").join(t.select("t", F.col("name").alias("n"), F.col("address").alias("a")), "t")
    want = met.selectExpr("count(*)", "count(distinct q)", "sum(cast(name = n and address = a as int))", "sum(bit_count(block_mask))").first()
    seen = []
    real = baseline.batch_features
    monkeypatch.setattr(baseline, "batch_features", lambda q, *rest: seen.append(q.count()) or real(q, *rest))
    assert tuple(record_queries.batch_pairs(spark, str(tmp_path)).first()) == tuple(want) and seen == [4] and want[1] == 24


def test_lexical_features_of_equal_queries(spark, tmp_path):
    from spanlink.plans.queries import QUERIES, sides

    rows = [(k, ("red ring", "Blue plate")[k // 3 % 2], f"Brand#{k // 6 % 2}", "tin", k // 3 % 2) for k in range(72)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    q, t = (X.prepare(x) for x in sides(spark, str(tmp_path)))
    pairs = blocking.block_candidates(q, blocking.build_index(t), 100)
    want = features.lexical_features(pairs, q, t)
    out = sinks.stored(QUERIES["lexical_features"](spark, str(tmp_path)), "out")
    assert out.where("t is null").count() == 20 and out.where("t is not null").select("q").distinct().count() == 4
    members = out.select("q", "same_as").distinct()
    whole = out.where("t is not null").drop("q").join(members, "same_as")
    assert members.count() == 24 and values(whole, *want.columns) == values(want)


@pytest.mark.parametrize(("name", "list_keys", "task_pairs"), [("Blue plate", 1000, 10**6), ("Plaque d'Été", 5, 30)])
def test_tfidf_pairs_of_equal_records(spark, tmp_path, monkeypatch, name, list_keys, task_pairs):
    from spanlink.operators import values as V
    from spanlink.plans import record_queries
    from spanlink.plans.queries import sides

    rows = [(k, ("red ring", name, "ringed  PLATE", "?")[k // 3 % 4], f"Brand#{k // 12 % 2}", "tin", k // 12 % 2) for k in range(144)]
    rows += [(k, (None, "solo")[k % 2], "Brand#9", "tin", 9) for k in range(200, 206)] + [(None, "solo", "Brand#9", "tin", 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    q, t = (X.prepare(x) for x in sides(spark, str(tmp_path)))
    idf, postings = sparse.fit(t, "t", "name", 3, 5, 2, None, True)
    asked = sparse.weigh(sparse.term_counts(q, "q", "name", 3, 5), idf, True)
    met = q.select("q", "address").join(t.select("t", "address"), "address").select("q", "t")
    want = sparse.pair_cosine(met, asked, postings, "s").select("q", "t", F.round("s", 6).alias("s"))
    monkeypatch.setattr(V, "LIST_KEYS", list_keys)
    monkeypatch.setattr(V, "TASK_PAIRS", task_pairs)
    seen, real = [], sparse.text_cosine
    monkeypatch.setattr(sparse, "text_cosine", lambda pairs, *a, **b: seen.append(pairs.count()) or real(pairs, *a, **b))
    out = values(record_queries.tfidf_pairs(spark, str(tmp_path)))
    assert out == values(want) and len(out) == 2 * 24 * 48 + 2 * 4
    assert seen == [2 * 16 + 4] if list_keys == 1000 else 2 * 16 + 4 < seen[0] < len(out)


def test_lists_that_meet(spark, monkeypatch):
    from spanlink.operators import values as V

    monkeypatch.setattr(V, "LIST_KEYS", 10)
    monkeypatch.setattr(V, "TASK_PAIRS", 100)
    df = lambda k, n: spark.range(n).select(F.concat(F.lit(k), "id").alias(k), F.when(F.col("id") < n - 2, "a").otherwise("b").alias("x"))
    q, t = df("q", 90), df("t", 50)
    some = [V.lists(x, k, "x") for x, k in ((q, "q"), (t, "t"))]
    assert all(max(len(r[k]) for r in x.collect()) <= 30 for x, k in zip(some, "qt", strict=True))
    met = V.meet(*some, "q", "t", "x")
    assert met.groupBy("x").agg(F.count("*").alias("n")).where("x = 'a' and n > 20").count() == 1
    assert values(met.select("x", F.explode("q").alias("q"), "t").select("q", F.explode("t").alias("t"))) == values(q.join(t, "x").select("q", "t"))
    plain = spark.createDataFrame([(" A&b ", "NaN"), (None, "x-1")], "business_name string, business_address string")
    assert X.all_ascii(plain, "business_name") and values(X.prepare(plain, True), "name", "address", "core", "digits") == values(X.prepare(plain), "name", "address", "core", "digits")
    assert not X.all_ascii(spark.createDataFrame([("é",)], "v string"), "v")

import numpy as np
import pytest

from spanlink.operators import dense, models


def vectors(spark, n, seed, dim=16):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    return dense.unit(spark.createDataFrame([(f"t{i:04}", row.tolist()) for i, row in enumerate(v)], "id string, vector array<double>"))


def test_coded_search_recall(spark, tmp_path, monkeypatch):
    targets = vectors(spark, 1500, 1)
    queries = targets.where("cast(substring(id, 2) as int) % 50 = 0")
    centers = dense.fit_cells(targets, 6)
    codes = dense.fit_codes(targets, centers, 8)
    monkeypatch.setattr(dense, "CELL_ROWS", 100)  # cells of several parts
    dense.save_index(dense.build_coded(targets, codes), codes, str(tmp_path), "toy")
    coded, loaded = dense.load_index(spark, str(tmp_path), "toy")
    assert coded.count() == 1500 and coded.groupBy("cell", "part").count().count() > 6
    found = dense.coded_search(queries, coded, loaded, 4, 10, targets=targets)
    best = dense.exact_top_k(queries, targets, 10)
    report = dense.recall_report(best.select("q", "t"), {"coded": found}).first()
    assert report["links"] == 300 and report["recall_coded"] >= 0.9
    assert dense.coded_search(queries, coded, loaded, 4, 10).count() == 300
    ranks = found.groupBy("q").agg({"rank": "max"}).collect()
    assert len(ranks) == 30 and all(r[1] == 10 for r in ranks)
    with pytest.raises(ValueError, match="encoder"):
        dense.load_index(spark, str(tmp_path), "other")
    with pytest.raises(ValueError, match="parts"):
        dense.fit_codes(targets, centers, 5)


def test_code_scores_are_products_of_decoded_vectors():
    rng = np.random.default_rng(3)
    centers, books = rng.normal(size=(3, 8)), rng.normal(size=(4, 256, 2))
    codes, cells = dense.Codes(centers, books), np.array([1, 1, 1])
    v, q = rng.normal(size=(3, 8)), rng.normal(size=(2, 8))
    coded = codes.encode(v, cells)
    decoded = centers[1] + np.stack([np.concatenate([books[j, c] for j, c in enumerate(row)]) for row in coded])
    assert np.allclose(codes.scores(q, 1, coded), q @ decoded.T)
    nearest = [[int(((v[i, 2 * j : 2 * j + 2] - centers[1, 2 * j : 2 * j + 2] - books[j]) ** 2).sum(axis=1).argmin()) for j in range(4)] for i in range(3)]
    assert coded.tolist() == nearest


def test_shards_are_encoded_once(spark, tmp_path):
    df = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 30)], "k string, text string")
    encoder = lambda texts: np.array([[len(t), 1.0] for t in texts])
    first = dense.encode_shards(df, "k", "text", encoder, str(tmp_path), 3)
    assert first.count() == 29

    def fails(texts):
        raise AssertionError

    assert sorted(dense.encode_shards(df, "k", "text", fails, str(tmp_path), 3).collect()) == sorted(first.collect())


def test_yes_no_reranker(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "query_text string, target_text string")
    score = models.yes_no_scorer(lambda asked: [(0.0, 2.0 if p.split("\n")[1][7:] == p.split("\n")[2][8:] else -2.0) for p in asked])
    got = {r["target_text"]: r["rerank_score"] for r in models.rerank(pairs, score).collect()}
    assert got["a"] == pytest.approx(0.8808, abs=1e-4) and got["b"] == pytest.approx(0.1192, abs=1e-4)

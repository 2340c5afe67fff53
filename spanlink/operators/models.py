"""Models on Spark ML: cross-fitted boosted trees, calibration, existence and count models, pluggable rerankers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import numeric_columns

DEFAULTS = {"maxDepth": 5, "maxBins": 64, "minInstancesPerNode": 20, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.75", "stepSize": 0.1, "maxIter": 40, "seed": 42}


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x").transform(df.na.fill(0, features))


def _fit(df: DataFrame, features: list[str], params: dict, label: str = "label") -> GBTClassificationModel:
    classes = df.select(F.countDistinct(label)).first()[0]
    if classes < 2:
        raise ValueError("both classes are needed")
    return GBTClassifier(featuresCol="__x", labelCol=label, **{**DEFAULTS, **params}).fit(_assembled(df.withColumn(label, F.col(label).cast("double")), features))


def _score(df: DataFrame, model, features: list[str], name: str = "score") -> DataFrame:
    out = model.transform(_assembled(df, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


#: Names of tree settings in common configuration files, and what they are here.
TREE_NAMES = {"n_estimators": "maxIter", "rounds": "maxIter", "learning_rate": "stepSize", "min_child_samples": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode", "colsample_bytree": "featureSubsetStrategy", "feature_fraction": "featureSubsetStrategy", "subsample": "subsamplingRate", "bagging_fraction": "subsamplingRate", "seed": "seed"}


def tree_params(settings: dict) -> dict:
    """Settings of leaf-wise trees as Spark's: a number of leaves becomes the depth that holds them; others are passed over."""
    out = {k: v for k, v in settings.items() if k in DEFAULTS}
    for name, value in settings.items():
        if name == "num_leaves":
            out["maxDepth"] = max(1, min(10, (int(value) - 1).bit_length()))
        elif name in TREE_NAMES:
            out[TREE_NAMES[name]] = str(value) if TREE_NAMES[name] == "featureSubsetStrategy" else value
    return out


def fit_trees(df: DataFrame, columns: list[str], params: dict) -> GBTClassificationModel:
    """Boosted trees for label; an error where it has one class alone."""
    return _fit(df, columns, params)


def score_trees(df: DataFrame, model: GBTClassificationModel, columns: list[str]) -> DataFrame:
    """Adds score, the probability of label 1."""
    return _score(df, model, columns)


def load_trees(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


@dataclass
class Ensemble:
    features: list[str]
    models: list = field(default_factory=list)
    full: object = None
    oof: DataFrame | None = None

    def predict(self, df: DataFrame, use_full: bool = False) -> DataFrame:
        """Mean of the fold models' scores, or the full model's."""
        if use_full:
            return _score(df, self.full, self.features)
        names = [f"__s{i}" for i in range(len(self.models))]
        for name, m in zip(names, self.models, strict=True):
            df = _score(df, m, self.features, name)
        return df.withColumn("score", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)

    def save(self, path: str) -> None:
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/fold{i}")
        if self.full is not None:
            self.full.write().overwrite().save(f"{path}/full")
        from pyspark.sql import SparkSession

        SparkSession.active().createDataFrame([(",".join(self.features), len(self.models), self.full is not None)], "features string, folds int, full boolean").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Ensemble:
        meta = spark.read.json(f"{path}/meta").first()
        load = GBTClassificationModel.load
        return cls(meta["features"].split(","), [load(f"{path}/fold{i}") for i in range(meta["folds"])], load(f"{path}/full") if meta["full"] else None)


def train_cross_fitted(df: DataFrame, folds: int = 5, features: list[str] | None = None, params: dict | None = None, refit_all: bool = True) -> Ensemble:
    """A model for each fold, fitted on the others; oof has each row's score from the model that has not seen it."""
    features = features or [c for c in numeric_columns(df) if c != "fold"]
    out = Ensemble(features)
    for f in range(folds):
        model = _fit(df.where(F.col("fold") != f), features, params or {})
        out.models.append(model)
        part = _score(df.where(F.col("fold") == f), model, features)
        out.oof = part if out.oof is None else out.oof.unionByName(part)
    if refit_all:
        out.full = _fit(df, features, params or {})
    return out


class ProbabilityCalibrator:
    """Platt or isotonic calibration, with segments of their own where they are large enough and have both classes."""

    def __init__(self, method: str = "platt", min_segment: int = 10_000) -> None:
        if method not in ("platt", "isotonic"):
            raise ValueError(f"unknown calibration {method!r}")
        self.method, self.min_segment, self.models = method, min_segment, {}

    def _one(self, df: DataFrame, n: int):
        rows = df.select(F.col("label").cast("double").alias("label"), F.col("score").cast("double").alias("score"))
        if self.method == "isotonic":
            return IsotonicRegression(featuresCol="score").fit(rows)
        return LogisticRegression(featuresCol="__x", regParam=1 / max(1, n), standardization=False).fit(_assembled(rows, ["score"]))

    def fit(self, df: DataFrame, segment: str | None = None) -> ProbabilityCalibrator:
        n = df.count()
        self.segment, self.models = segment, {None: self._one(df, n)}
        if segment:
            sizes = df.groupBy(segment).agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).where((F.col("n") >= self.min_segment) & (F.col("k") > 1)).collect()
            self.models |= {r[segment]: self._one(df.where(F.col(segment) == r[segment]), r["n"]) for r in sizes}
        return self

    def save(self, path: str) -> None:
        """Models by segment, with the method and the segment's column."""
        from pyspark.sql import SparkSession

        keys = list(self.models)
        for i, k in enumerate(keys):
            self.models[k].write().overwrite().save(f"{path}/model{i}")
        rows = [(self.method, self.segment, i, None if k is None else str(k)) for i, k in enumerate(keys)]
        SparkSession.active().createDataFrame(rows, "method string, segment string, model int, value string").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> ProbabilityCalibrator:
        rows = [r.asDict() for r in spark.read.schema("method string, segment string, model int, value string").json(f"{path}/meta").collect()]  # a row a segment
        out = cls(rows[0]["method"])
        kind = IsotonicRegressionModel if out.method == "isotonic" else LogisticRegressionModel
        out.segment, out.models = rows[0]["segment"], {r["value"]: kind.load(f"{path}/model{r['model']}") for r in rows}
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds calibrated."""
        parts, rest = [], df
        for value, model in self.models.items():
            if value is not None:
                parts.append(self._apply(df.where(F.col(self.segment) == value), model))
                rest = rest.where(F.coalesce(F.col(self.segment) != value, F.lit(True)))
        out = self._apply(rest, self.models[None])
        for p in parts:
            out = out.unionByName(p)
        return out

    def _apply(self, df: DataFrame, model) -> DataFrame:
        if self.method == "isotonic":
            return model.transform(df.withColumn("score", F.col("score").cast("double"))).withColumnRenamed("prediction", "calibrated")
        return _score(df, model, ["score"], "calibrated")


class QueryModels:
    """Existence (has the query a match) and count (how many) from query aggregates."""

    def fit(self, aggregates: DataFrame, true_counts: DataFrame, params: dict | None = None) -> QueryModels:
        self.features = [c for c in aggregates.columns if c != "q"]
        df = aggregates.join(true_counts.select("q", F.col("n_true").cast("double").alias("n_true")), "q").withColumn("label", (F.col("n_true") > 0).cast("double"))
        self.exists = _fit(df, self.features, params or {})
        self.counts = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="__x", labelCol="n_true", regParam=0.1).fit(_assembled(df, self.features))
        return self

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        self.exists.write().overwrite().save(f"{path}/exists")
        self.counts.write().overwrite().save(f"{path}/counts")
        SparkSession.active().createDataFrame([(f,) for f in self.features], "feature string").coalesce(1).write.mode("overwrite").text(f"{path}/features")

    @classmethod
    def load(cls, spark, path: str) -> QueryModels:
        out = cls()
        out.features = [r["value"] for r in spark.read.text(f"{path}/features").collect()]  # ten names
        out.exists, out.counts = GBTClassificationModel.load(f"{path}/exists"), GeneralizedLinearRegressionModel.load(f"{path}/counts")
        return out

    def predict(self, aggregates: DataFrame) -> DataFrame:
        """(q, existence, expected_count)."""
        df = _score(aggregates, self.exists, self.features, "existence")
        return self.counts.transform(_assembled(df, self.features)).select("q", "existence", F.greatest(F.lit(0.0), F.col("prediction")).alias("expected_count"))


def yes_no_scorer(logits: Callable[[list[str]], list[tuple[float, float]]], instruction: str = "Do the two records name the same business?") -> Callable[[list[str], list[str]], list[float]]:
    """A scorer for rerank: probability of yes against no, from a model's logits (no, yes) of the next token after a prompt."""

    def score(a: list[str], b: list[str]) -> list[float]:
        asked = [f"{instruction}\nFirst: {x}\nSecond: {y}\nAnswer yes or no: " for x, y in zip(a, b, strict=True)]
        return [1 / (1 + math.exp(min(700.0, max(-700.0, no - yes)))) for no, yes in logits(asked)]

    return score


def rerank(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 16) -> DataFrame:
    """Adds rerank_score of a pluggable pair scorer over query_text and target_text; a batch that runs out of memory is halved."""

    def scored(a: list[str], b: list[str]) -> list[float]:
        try:
            return list(scorer(a, b))
        except MemoryError:
            if len(a) == 1:
                raise
            h = len(a) // 2
            return scored(a[:h], b[:h]) + scored(a[h:], b[h:])

    def run(frames):
        for f in frames:
            out: list[float] = []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                out += scored(part["query_text"].tolist(), part["target_text"].tolist())
            yield f.assign(rerank_score=pd.Series(out, index=f.index, dtype="float64"))

    schema = ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes) + ", rerank_score double"
    return pairs.mapInPandas(run, schema)

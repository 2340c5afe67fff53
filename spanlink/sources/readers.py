"""Sources: record TSVs, tables by suffix, truth, JSONL, settings and the built-in smoke records."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path, schema: T.StructType | None = None, recursive: bool = False) -> DataFrame:
    """Tab-separated text with a header and doubled quotes, all strings; blanks stay empty strings."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tsv")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_records(spark: SparkSession, data_dir: str, split: str, sources: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    parts = [read_tsv(spark, f"{data_dir}/{split}_source{n}.tsv", RECORD) for n in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, TSV or CSV by suffix; other suffixes are errors."""
    suffix = Path(path).suffix.lower()
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix in (".tsv", ".txt"):
        return read_tsv(spark, path)
    if suffix == ".csv":
        return spark.read.option("header", True).option("escape", '"').csv(path)
    raise ValueError(f"no reader for {path}")


def id_list(text):
    """Ids of a comma-joined list; a repeated id stops the job."""
    ids = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(F.array_distinct(ids)) == F.size(ids), ids).otherwise(F.raise_error(F.concat(F.lit("repeated id in "), text)))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows; a source-1 id that occurs twice is an error."""
    df = read_tsv(spark, path, TRUTH)
    twice = df.groupBy("source1_entity_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated truth rows: {[r[0] for r in twice]}")
    return df


def truth_to_pairs(truth: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    return truth.select(F.col(key).alias("q"), F.explode(F.split(F.coalesce(ids, F.lit("")), ",")).alias("t")).select("q", F.trim("t").alias("t")).where("t <> ''").dropDuplicates()


def read_model_rows(spark: SparkSession, path: str, columns: list[str], split: str) -> DataFrame:
    """Projection and filter reach the Parquet scan."""
    return spark.read.parquet(path).where(F.col("split") == split).select(*columns)


def schema_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def read_embeddings(spark: SparkSession, path: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_text string, target_text string, label int").json(path)


def lookup(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Records of a table of ids: a join, never one probe a row."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest seeded hashes: the same rows in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def prepare_split(spark: SparkSession, data_dir: str, out: str, split: str) -> dict[str, str]:
    """Write queries (source 1), targets (2 and 3) and, for the training split, truth pairs as Parquet."""
    paths = {"queries": f"{out}/{split}_queries.parquet", "targets": f"{out}/{split}_targets.parquet"}
    read_records(spark, data_dir, split, (1,)).write.mode("overwrite").parquet(paths["queries"])
    read_records(spark, data_dir, split, (2, 3)).write.mode("overwrite").parquet(paths["targets"])
    if split == "train":
        paths["truth"] = f"{out}/{split}_truth.parquet"
        truth_to_pairs(read_truth(spark, f"{data_dir}/{split}_ground_truth.tsv")).write.mode("overwrite").parquet(paths["truth"])
    return paths


def smoke_records(spark: SparkSession, n: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """n queries, 2n targets and n true pairs, made by rule."""
    streets, kinds = ("North Road", "East Avenue", "South Lane", "West Street"), ("Foods", "Textiles", "Motors", "Books", "Steel", "Dairy")
    base = [(i, f"{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[i % 26]}lpha{i} {kinds[i % 6]}", f"{10 + 7 * i} {streets[i % 4]}", f"90000{i:05d}", ("IN", "US", "FR")[i % 3]) for i in range(n)]
    columns = "string, name string, address string, phone string, country string"
    queries = spark.createDataFrame([(f"S1-{i + 1}", *r) for i, *r in base], f"q {columns}")
    true = [(f"S2-{i + 1}", f"{r[0]} Ltd", r[1].replace("Road", "Rd"), r[2], r[3]) for i, *r in base]
    other = [(f"S3-{i + 1}", f"Zeta{i * 13 + 5} Traders", f"{500 + i} Harbour Way", f"80000{i:05d}", r[3]) for i, *r in base]
    targets = spark.createDataFrame(true + other, f"t {columns}")
    return queries, targets, spark.createDataFrame([(f"S1-{i + 1}", f"S2-{i + 1}") for i in range(n)], "q string, t string")


DEFAULTS = {
    "seed": 42, "paths": {"data": "data", "out": "out", "data_dir": "dataset", "work_dir": "work", "output_dir": "output"}, "runtime": {"device": "cpu"},
    "validation": {"folds": 5, "seed": 42, "evaluation_fold": 0, "beta": 0.5}, "retrieval": {"top_k": 120, "final_cap": 250, "rrf_k": 60}, "normalization": {"keep_native": True},
    "candidates": {"top_k": 120, "final_cap": 250, "rrf_k": 60, "sparse": {"enabled": True, "ngram_range": [2, 5], "max_features": 400_000, "top_k": 120}, "dense": {"enabled": False}}, "gbdt": {"rounds": 40, "params": {}}, "reranker": {"enabled": False},
    "decoder": {"strategy": "expected_f_exclusive", "beta": 0.5, "k_max": 25, "threshold": 0.5, "extra_miss": 0.0},
}
STRATEGIES = ("threshold", "threshold_exclusive", "expected_f", "expected_f_exclusive", "pi_exclusive")


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Settings:
    """Nested settings with dotted access."""

    def __init__(self, values: dict) -> None:
        self.values = values

    def path(self, name: str) -> str:
        """The folder paths.name; an error where there is none."""
        if not self.get(f"paths.{name}"):
            raise KeyError(f"paths.{name} is missing")
        return str(Path(self.get(f"paths.{name}")).expanduser().resolve())

    def get(self, name: str, default=None):
        at = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at


def load_settings(path: str | None = None, overrides: dict | None = None) -> Settings:
    """Defaults, then the YAML file, then overrides; checked. Relative folders are taken from the file's grandparent."""
    values = DEFAULTS
    if path:
        import yaml

        values = merged(values, yaml.safe_load(Path(path).read_text()) or {})
        root = Path(path).resolve().parent.parent
        values = merged(values, {"paths": {k: str(root / v) for k, v in values["paths"].items()}})
    values = merged(values, overrides or {})
    s = Settings(values)
    if missing := [name for name in DEFAULTS if name not in s.values or not isinstance(s.values[name], type(DEFAULTS[name]))]:
        raise ValueError(f"settings lack sections: {missing}")
    if s.get("validation.folds") < 2:
        raise ValueError("validation.folds must be 2 or more")
    if not 0 <= s.get("validation.evaluation_fold") < s.get("validation.folds"):
        raise ValueError("validation.evaluation_fold must be one of the folds")
    if not 0 < s.get("candidates.top_k") <= s.get("candidates.final_cap"):
        raise ValueError("candidates.top_k must be positive and candidates.final_cap no smaller")
    if s.get("decoder.strategy") not in STRATEGIES:
        raise ValueError(f"unknown decoder.strategy {s.get('decoder.strategy')!r}")
    if not 0 < s.get("decoder.beta"):
        raise ValueError("decoder.beta must be positive")
    return s

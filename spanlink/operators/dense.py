"""Dense retrieval over stored vectors: exact blocked top-k, KMeans cells, and product-quantised cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are sent to all tasks as one matrix, at most; more are taken in several matrices.
QUERY_BLOCK = 20_000


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """(id, vector): unit vectors of a pluggable encoder, in batches on the executors."""

    def run(frames):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                v = np.asarray(encoder(part["text"].tolist()), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": list(v)})

    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, vector array<float>")


def unit(df: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("vector", F.transform("vector", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12))))


def exact_top_k(queries: DataFrame, targets: DataFrame, top_k: int, source: str = "dense", block: int = QUERY_BLOCK) -> DataFrame:
    """Candidates by inner product. Each task keeps top_k a query, so the shuffle carries tasks * queries * top_k rows at most."""
    parts = []
    total = queries.count()
    numbered = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // block)))))
    for i in range(max(1, -(-total // block))):
        rows = numbered.where(F.col("part") == i).select("id", "vector").toPandas()  # about `block` query vectors
        if len(rows):
            parts.append(_against(rows, targets, top_k))
    if not parts:
        return queries.sparkSession.createDataFrame([], "q string, t string, retrieval_source string, rank int, retrieval_score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("retrieval_score"), "t"))).where(F.col("rank") <= top_k)
    return ranked.select("q", "t", F.lit(source).alias("retrieval_source"), "rank", "retrieval_score")


def _against(rows: pd.DataFrame, targets: DataFrame, top_k: int) -> DataFrame:
    shared = targets.sparkSession.sparkContext.broadcast((rows["id"].astype(str).to_numpy(), np.stack(rows["vector"].map(lambda v: np.asarray(v, np.float64)))))

    def run(frames):
        ids, matrix = shared.value
        for f in frames:
            if not len(f):
                continue
            t = f["id"].astype(str).to_numpy()
            v = np.stack(f["vector"].map(lambda x: np.asarray(x, np.float64)))
            for at in range(0, len(ids), 1024):
                s = matrix[at : at + 1024] @ v.T
                order = np.argsort(t)
                best = order[np.argsort(-np.round(s[:, order], 12), axis=1, kind="stable")[:, :top_k]]
                q = np.repeat(ids[at : at + 1024], best.shape[1])
                yield pd.DataFrame({"q": q, "t": t[best.ravel()], "retrieval_score": np.take_along_axis(s, best, 1).ravel()})

    return targets.select(F.col("id").cast("string").alias("id"), "vector").mapInPandas(run, "q string, t string, retrieval_score double")


def fit_cells(targets: DataFrame, cells: int, sample: int = 100_000, seed: int = 1) -> np.ndarray:
    """Unit centroids of Spark ML KMeans on a seeded sample of the targets."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = targets.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(rows).clusterCenters())
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)


def assign_cells(df: DataFrame, centers: np.ndarray, n: int) -> DataFrame:
    """(id, vector, cell): one row for each of a vector's n nearest cells."""

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        s = np.stack(v.map(lambda x: np.asarray(x, np.float64))) @ centers.T
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.select("id", "vector", F.explode(nearest("vector")).alias("cell"))


def cell_search(queries: DataFrame, cells: DataFrame, centers: np.ndarray, nprobe: int, top_k: int, source: str = "dense_ivf") -> DataFrame:
    """Candidates of the nprobe nearest cells, rescored exactly. cells: assign_cells(targets, centers, 1)."""
    probes = assign_cells(queries, centers, nprobe).select(F.col("id").cast("string").alias("q"), F.col("vector").alias("v"), "cell")
    score = F.aggregate(F.zip_with("v", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    met = probes.join(cells, "cell").select("q", F.col("id").cast("string").alias("t"), score.alias("retrieval_score"))
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("retrieval_score"), "t"))).where(F.col("rank") <= top_k)
    return ranked.select("q", "t", F.lit(source).alias("retrieval_source"), "rank", "retrieval_score")


def recall_report(truth: DataFrame, found: dict[str, DataFrame], by: str | None = None) -> DataFrame:
    """Micro recall of each candidate set and of their union, by a truth column where one is named."""
    union = None
    for df in found.values():
        pairs = df.select("q", "t").distinct()
        union = pairs if union is None else union.unionByName(pairs).distinct()
    out = truth
    for name, df in [*found.items(), ("union", union)]:
        out = out.join(df.select("q", "t").distinct().withColumn(name, F.lit(1)), ["q", "t"], "left")
    keys = [by] if by else []
    return out.groupBy(*keys).agg(F.count("*").alias("links"), *[F.avg(F.coalesce(F.col(n), F.lit(0))).alias(f"recall_{n}") for n in [*found, "union"]])


def encode_shards(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], path: str, shards: int = 16, batch: int = 256) -> DataFrame:
    """(id, vector) of a whole corpus in `shards` Parquet tables below path; a finished one is not encoded again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i in range(shards):
        folder = f"{path}/shard={i}"
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            part = df.where(F.pmod(F.xxhash64(key), F.lit(shards)) == i)
            encode(part, key, text, encoder, batch).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.parquet(path).select("id", "vector")


@dataclass
class Codes:
    """A product quantiser: the residual of a vector to its cell's centre is cut into parts, each the nearest of 256 codes."""

    centers: np.ndarray  # (cells, dim)
    books: np.ndarray  # (parts, 256, dim / parts)

    def encode(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = vectors - self.centers[cells]
        m, k, d = self.books.shape
        out = np.empty((len(rest), m), np.int16)
        for j in range(m):
            x = rest[:, j * d : (j + 1) * d]
            out[:, j] = ((self.books[j] ** 2).sum(axis=1)[None] - 2 * x @ self.books[j].T).argmin(axis=1)
        return out

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded vectors of one cell, from one table of part products a query."""
        m, k, d = self.books.shape
        out = np.repeat((queries @ self.centers[cell])[:, None], len(codes), axis=1)
        for j in range(m):
            out += (queries[:, j * d : (j + 1) * d] @ self.books[j].T)[:, codes[:, j]]
        return out


def fit_codes(targets: DataFrame, centers: np.ndarray, parts: int, sample: int = 50_000, rounds: int = 10, seed: int = 1) -> Codes:
    """Code books by k-means on the residuals of a seeded sample of at most `sample` vectors."""
    rows = targets.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vector").toPandas()["vector"]  # the sample bounds it
    v = np.stack(rows.map(lambda x: np.asarray(x, np.float64)))
    if v.shape[1] % parts:
        raise ValueError(f"{v.shape[1]} dimensions cannot be cut into {parts} parts")
    rest, d = v - centers[(v @ centers.T).argmax(axis=1)], v.shape[1] // parts
    rng, books = np.random.default_rng(seed), []
    for j in range(parts):
        x = rest[:, j * d : (j + 1) * d]
        book = x[rng.choice(len(x), 256, replace=len(x) < 256)]
        for _ in range(rounds):
            near = ((book**2).sum(axis=1)[None] - 2 * x @ book.T).argmin(axis=1)
            count = np.bincount(near, minlength=256)
            mean = np.stack([np.bincount(near, x[:, i], 256) for i in range(d)], 1) / np.maximum(count, 1)[:, None]
            book = np.where(count[:, None] > 0, mean, book)
        books.append(book)
    return Codes(centers, np.stack(books))


#: Coded vectors of a cell that one task compares with the queries that probe it.
CELL_ROWS = 100_000


def build_coded(targets: DataFrame, codes: Codes) -> DataFrame:
    """(id, cell, part, codes): each vector in its nearest cell; cells of more than CELL_ROWS vectors are dealt to several parts."""
    celled = assign_cells(targets, codes.centers, 1)

    def run(frames):
        for f in frames:
            if len(f):
                v = np.stack(f["vector"].map(lambda x: np.asarray(x, np.float64)))
                yield pd.DataFrame({"id": f["id"].astype(str), "cell": f["cell"], "codes": list(codes.encode(v, f["cell"].to_numpy()))})

    coded = celled.mapInPandas(run, "id string, cell int, codes array<smallint>")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))  # a row a cell
    return coded.join(F.broadcast(sizes), "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts", "codes")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def coded_search(queries: DataFrame, coded: DataFrame, codes: Codes, nprobe: int, top_k: int, source: str = "dense_ivfpq", targets: DataFrame | None = None, refine: int = 10) -> DataFrame:
    """Candidates of the nprobe nearest cells by coded inner products; each cell part keeps what it has best for a query.

    With targets (id, vector), the refine * top_k best by codes are scored again by their vectors.
    """
    wanted = top_k * (refine if targets is not None else 1)
    parts = coded.groupBy("cell").agg(F.first("parts").alias("parts"))
    probes = assign_cells(queries, codes.centers, nprobe).join(F.broadcast(parts), "cell")  # a row a cell
    probes = probes.select(F.col("id").cast("string").alias("q"), "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def compare(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"q": [], "t": [], "retrieval_score": []})
        held = held.sort_values("id", kind="stable")
        table, ids, found = np.stack(held["codes"].map(np.asarray)), held["id"].to_numpy(), []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            s = codes.scores(np.stack(part["vector"].map(lambda x: np.asarray(x, np.float64))), key[0], table)
            best = np.argsort(-s, axis=1, kind="stable")[:, :wanted]
            found.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), best.shape[1]), "t": ids[best.ravel()], "retrieval_score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(found)

    met = probes.groupBy("cell", "part").cogroup(coded.groupBy("cell", "part")).applyInPandas(compare, "q string, t string, retrieval_score double")
    order = W.partitionBy("q").orderBy(F.desc("retrieval_score"), "t")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    if targets is not None:
        asked, held = queries.select(F.col("id").cast("string").alias("q"), F.col("vector").alias("v")), targets.select(F.col("id").cast("string").alias("t"), F.col("vector").alias("w"))
        again = ranked.select("q", "t").join(asked, "q").join(held, "t").select("q", "t", _dot("v", "w").alias("retrieval_score"))
        ranked = again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("q", "t", F.lit(source).alias("retrieval_source"), "rank", "retrieval_score")


def save_index(coded: DataFrame, codes: Codes, path: str, encoder: str = "") -> None:
    """A coded index with its centres and books, and the name of the encoder that made the vectors."""
    coded.write.mode("overwrite").parquet(f"{path}/coded")
    tables = [("centers", codes.centers.ravel().tolist(), list(codes.centers.shape)), ("books", codes.books.ravel().tolist(), list(codes.books.shape))]
    rows = coded.sparkSession.createDataFrame([(n, v, s, encoder) for n, v, s in tables], "name string, vals array<double>, shape array<int>, encoder string")
    rows.write.mode("overwrite").parquet(f"{path}/codes")


def load_index(spark, path: str, encoder: str = "") -> tuple[DataFrame, Codes]:
    """(coded, codes); an index of another encoder is refused."""
    rows = {r["name"]: r for r in spark.read.parquet(f"{path}/codes").collect()}  # two rows
    if rows["centers"]["encoder"] != encoder:
        raise ValueError(f"the index is of encoder {rows['centers']['encoder']!r}")
    table = lambda n: np.array(rows[n]["vals"]).reshape(rows[n]["shape"])
    return spark.read.parquet(f"{path}/coded"), Codes(table("centers"), table("books"))

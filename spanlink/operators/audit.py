"""Audits of record tables and checks of submission files."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)
#: Fixed value: form of a record id.
ID_FORM = r"^S[123]-(0|[1-9][0-9]{0,8})$"


def table_profile(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """One row: rows, distinct keys, repeated keys and rows, and for each text column blanks, non-ASCII texts, digits and lengths."""
    per = []
    for c in texts:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        per += [F.count_if(F.trim(v) == "").alias(f"{c}_blank"), F.count_if(v.rlike(r"[^\x00-\x7F]")).alias(f"{c}_non_ascii"), F.count_if(v.rlike(r"\p{Nd}")).alias(f"{c}_with_digit"), F.max(F.length(v)).alias(f"{c}_longest")]
    out = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.countDistinct(F.xxhash64(*df.columns)).alias("__rows"), *per)
    return out.withColumns({"repeated_keys": F.col("rows") - F.col("keys"), "repeated_rows": F.col("rows") - F.col("__rows")}).drop("__rows")


def histogram(df: DataFrame, value: Column, *by: str) -> DataFrame:
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("rows"))


def quantiles(hist: DataFrame, *by: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(by, level, value): smallest value whose cumulative count reaches the level; from a histogram, never from rows."""
    w = W.partitionBy(*by).orderBy("value") if by else W.orderBy("value")
    total = F.sum("rows").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    running = hist.withColumns({"cum": F.sum("rows").over(w), "total": total})
    each = running.select(*by, "value", "cum", "total", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")).where(F.col("cum") >= F.col("level") * F.col("total"))
    return each.groupBy(*by, "level").agg(F.min("value").alias("value"))


@F.pandas_udf(T.StringType())
def char_name(v: pd.Series) -> pd.Series:
    return v.map(lambda c: unicodedata.name(c, "UNKNOWN") if c else None)


def token_count(v: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.regexp_count(F.coalesce(v, F.lit("")), F.lit(r"(?U)\S+"))


def target_frequencies(truth: DataFrame) -> DataFrame:
    """(frequency, targets): how many targets are linked so many times."""
    return truth.groupBy("t").agg(F.count("*").alias("frequency")).groupBy("frequency").agg(F.count("*").alias("targets"))


def _levels(df: DataFrame, value: Column) -> dict:
    return {str(r["level"]): r["value"] for r in quantiles(histogram(df, value)).collect()}  # one row a level


def record_report(df: DataFrame, key: str = "entity_id", texts: tuple[str, ...] = ("business_name", "business_address")) -> dict:
    """Counts, countries, blanks, patterns, length and token quantiles and frequent characters of a record file."""
    if bad := bad_ids(df, key).limit(3).collect():
        raise ValueError(f"ids of another form: {[r[key] for r in bad]}")
    out = table_profile(df, key, list(texts)).first().asDict()
    out["country"] = {r[0]: r[1] for r in df.groupBy("country").count().collect()}  # one row a country
    out["missing"] = df.agg(*[F.count_if(F.trim(c) == "").alias(c) for c in df.columns]).first().asDict()
    out["text"] = {}
    for c in texts:
        flags = {"punctuation": r"(?U)[^\w\s]", "numbers": r"\p{Nd}", "accents": r"[\x{00C0}-\x{024F}\x{0300}-\x{036F}]"}
        out["text"][c] = df.agg(*[F.count_if(F.col(c).rlike(p)).alias(n) for n, p in flags.items()]).first().asDict()
        out["text"][c] |= {"length_quantiles": _levels(df, F.length(c)), "token_quantiles": _levels(df, token_count(F.col(c)))}
    census = char_census(df.select(F.concat_ws(" ", *texts).alias("all")), "all")
    out["non_ascii_characters"] = [r.asDict() for r in census.withColumn("name", char_name("char")).collect()]  # the top 25
    return out


def truth_report(df: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> dict:
    """Cardinalities, sources and target frequencies of a truth file; a target that repeats within a row is an error."""
    listed = df.select(F.col(key).alias("q"), F.filter(F.split(ids, ","), lambda x: x != "").alias("ts"))
    if twice := listed.where(F.size("ts") > F.size(F.array_distinct("ts"))).limit(3).collect():
        raise ValueError(f"repeated targets of {[r['q'] for r in twice]}")
    has = lambda s: F.exists("ts", lambda x: x.startswith(s))
    out = listed.agg(F.count("*").alias("rows"), F.countDistinct("q").alias("keys"), F.sum(F.size("ts")).alias("links"), F.max(F.size("ts")).alias("max_cardinality"), F.count_if(has("S2-") & has("S3-")).alias("both_sources"), F.avg((F.size("ts") == 0).cast("double")).alias("singleton_fraction")).first().asDict()
    pairs = listed.select("q", F.explode("ts").alias("t"))
    out |= pairs.agg(F.count_if(F.col("t").startswith("S2-")).alias("s2_links"), F.count_if(F.col("t").startswith("S3-")).alias("s3_links")).first().asDict()
    out["match_cardinality"] = {r["matches"]: r["queries"] for r in cardinality(pairs, listed.select("q")).orderBy("matches").collect()}  # one row a size
    frequencies = {r["frequency"]: r["targets"] for r in target_frequencies(pairs).orderBy("frequency").collect()}  # one row a frequency
    return out | {"target_frequency_histogram": frequencies, "targets_linked_multiple_times": sum(n for f, n in frequencies.items() if f > 1), "max_target_frequency": max(frequencies, default=0)}


def char_census(df: DataFrame, text: str, top: int = 25) -> DataFrame:
    """(char, code, rows): the most frequent characters above U+007F; each text is reduced to them before it is split."""
    rest = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x7F]", "")
    chars = df.select(rest.alias("r")).where("r <> ''").select(F.explode(F.split("r", "")).alias("char")).where("char <> ''")
    return chars.groupBy("char").agg(F.count("*").alias("rows")).withColumn("code", F.ascii("char")).orderBy(F.desc("rows"), "code").limit(top).select("char", "code", "rows")


def bad_ids(df: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.where(~F.coalesce(F.col(key), F.lit("")).rlike(ID_FORM))


def cardinality(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(matches, queries): how many queries have so many true targets, none included."""
    n = queries.select("q").join(truth.groupBy("q").agg(F.countDistinct("t").alias("n")), "q", "left")
    return n.groupBy(F.coalesce("n", F.lit(0)).alias("matches")).agg(F.count("*").alias("queries"))


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(line, q, ids, tabs) of a submission file without its header."""
    lines = spark.read.text(path).where(~F.col("value").startswith("source1_entity_id\t"))
    return lines.select("value", F.split("value", "\t", 2)[0].alias("q"), F.coalesce(F.get(F.split("value", "\t", 2), F.lit(1)), F.lit("")).alias("ids"), (F.length("value") - F.length(F.replace("value", F.lit("\t"), F.lit("")))).alias("tabs"))


def submission_problems(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, level, rows, examples) of what is wrong with a file; examples are the smallest and largest id."""
    pairs = lists.select("q", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("t"))
    rules = [
        ("tab", lists.where("tabs <> 1").select("q")), ("repeated row", lists.groupBy("q").count().where("count > 1").select("q")), ("repeated id", pairs.groupBy("q", "t").count().where("count > 1").select("q")),
        ("self match", pairs.where(F.col("t").startswith("S1-")).select("q")), ("prefix", pairs.where(~F.col("t").rlike("^S[123]-")).select("q")), ("missing query", required.select("q").join(lists.select("q"), "q", "left_anti")), ("extra query", lists.select("q").join(required.select("q"), "q", "left_anti")),
    ]
    if known is not None:
        rules.append(("unknown id", pairs.where(F.col("t").rlike("^S[23]-")).join(known.select("t"), "t", "left_anti").select("q")))
    out = None
    for name, df in rules:
        # two examples come from running extremes: no set of all offenders is gathered
        part = df.agg(F.count("*").alias("rows"), F.filter(F.array(F.min("q"), F.max("q")), lambda x: x.isNotNull()).alias("examples")).select(F.lit(name).alias("rule"), F.lit("error").alias("level"), "rows", "examples")
        out = part if out is None else out.unionByName(part)
    return out.where("rows > 0")


def validate_submission(spark: SparkSession, results: str, required: DataFrame, candidates: str | None = None, known: DataFrame | None = None) -> tuple[bool, DataFrame]:
    """(valid, problems): warnings, about candidates, do not make a file invalid."""
    lists = read_id_lists(spark, results)
    problems = submission_problems(lists, required, known)
    explode = lambda df: df.select("q", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("t"))
    if candidates is not None:
        outside = explode(lists).join(explode(read_id_lists(spark, candidates)), ["q", "t"], "left_anti")
        problems = problems.unionByName(outside.agg(F.count("*").alias("rows"), F.filter(F.array(F.min("q"), F.max("q")), lambda x: x.isNotNull()).alias("examples")).select(F.lit("match is no candidate").alias("rule"), F.lit("warning").alias("level"), "rows", "examples").where("rows > 0"))
    found = problems.collect()  # a row a rule
    problems = spark.createDataFrame(found, problems.schema)
    return not any(r["level"] == "error" for r in found), problems

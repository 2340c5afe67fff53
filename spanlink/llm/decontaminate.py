"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification, natively.

Items are dealt into partitions by shingle count, [2^j, 2^(j+1)). The sketch of an item is the bottom-s part of its hashed
shingle set, with s from the partition's upper size so that an item of containment c >= percent must have at least
s - floor((100 - percent) * n / 100) sketch shingles in the document: the search loses no item. Rolling shingle hashes of
the whole documents meet the sketches in a hash join; pairs with enough hits are verified on the shingle texts.

Inputs: null, empty and blank items match nothing; an item of 1 to k-1 words is one gram of its own length and matches
documents in which these words stand together; null and empty documents match nothing; rows that share a doc_id (or an
item_id) count as one document (or item); rows with a null id never match, but `clean` gives them an id of their own. Other
columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize, space_words
from .grams import gram_keys, gram_texts, word_keys

#: A broadcast side has at most so many rows (about 40 bytes each); above that the join is shuffled.
MAX_BROADCAST_ROWS = 500_000


def _worded(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    df = df.select(F.col(key).alias("id"), ascii_lower(F.col(text).cast("string")).alias("t")).where("id is not null and t is not null")
    return df.select("id", space_words(F.col("t")).alias("w"))


def item_grams(benchmark: DataFrame, k: int) -> DataFrame:
    """(item_id, width, gram, h, n): distinct shingles of each item and their number; width is k, or the item's word count below k."""
    words = _worded(benchmark, "item_id").where(F.size("w") > 0).withColumn("width", F.least(F.lit(k), F.size("w")))
    grams = F.when(F.col("width") == k, gram_texts(F.col("w"), k)).otherwise(F.array(F.array_join("w", " ")))
    keys = word_keys(F.col("w"))
    hashes = F.when(F.col("width") == k, gram_keys(keys, k)).otherwise(F.array(F.xxhash64(keys)))
    pairs = words.select(F.col("id").alias("item_id"), "width", F.explode(F.arrays_zip(grams.alias("gram"), hashes.alias("h"))).alias("p"))
    pairs = pairs.select("item_id", "width", F.col("p.gram").alias("gram"), F.col("p.h").alias("h")).distinct()
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    return pairs.join(sizes, "item_id")


def sketches(grams: DataFrame, percent: int) -> DataFrame:
    """(item_id, width, h, need): bottom-s hashes of each item by size partition, and the hits a document needs."""
    miss = F.floor(F.col("n") * (100 - percent) / 100)
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1)
    length = F.least(F.col("n"), F.floor(2 * upper * (100 - percent) / 100) + 1)
    by_item = grams.select("item_id", "width", "n", "h").distinct().groupBy("item_id", "width", "n").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    cut = by_item.select("item_id", "width", F.slice("hs", 1, length.cast("int")).alias("hs"), (length - miss).alias("need"))
    return cut.select("item_id", "width", F.explode("hs").alias("h"), "need")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): pairs in which at least percent of the item's distinct shingles are in the document."""
    grams = materialize(item_grams(benchmark, k), "items")
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect())  # at most k values
    words = _worded(docs, "doc_id")
    if not widths:
        return words.select(F.col("id").alias("doc_id"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item")).where("false")

    def rolling(worded: DataFrame, build, column: str) -> DataFrame:
        def tagged(w: int):
            return F.transform(build(w), lambda g: F.struct(F.lit(w).alias("width"), g.alias(column)))

        if len(widths) == 1:
            return worded.select(F.col("id").alias("doc_id"), F.explode(build(widths[0])).alias(column)).withColumn("width", F.lit(widths[0]))
        return worded.select(F.col("id").alias("doc_id"), F.explode(F.concat(*map(tagged, widths))).alias("g")).select("doc_id", "g.*")

    keyed = words.select("id", word_keys(F.col("w")).alias("keys"))
    sketch = broadcast_if_small(materialize(sketches(grams, percent), "sketches"), MAX_BROADCAST_ROWS)
    hits = rolling(keyed, lambda w: gram_keys(F.col("keys"), w), "h").join(sketch, ["width", "h"])
    found = hits.groupBy("doc_id", "item_id", "need").agg(F.countDistinct("h").alias("hits")).where("hits >= need")
    found = materialize(found.select("doc_id", "item_id"), "candidates")
    suspects = broadcast_if_small(found.select("doc_id").distinct(), MAX_BROADCAST_ROWS)
    again = _worded(docs.join(suspects, "doc_id", "left_semi"), "doc_id")
    texts = rolling(again, lambda w: gram_texts(F.col("w"), w), "gram")
    shared = texts.join(broadcast_if_small(grams.select("item_id", "width", "gram", "n"), MAX_BROADCAST_ROWS), ["width", "gram"])
    counted = shared.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("gram").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n") * percent)
    return counted.join(found, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_shared", F.col("n").alias("n_item"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay.

    Rows are told apart by doc_id and a hash of the text, so each row of a repeated doc_id is judged by its own text, and so
    are rows without a doc_id.
    """
    row = F.struct("doc_id", F.xxhash64("text").alias("text"))
    bad = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark, k, percent).select("doc_id").distinct()
    bad = materialize(bad.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.text").alias("__text")), "contaminated")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__text"))
    return docs.join(broadcast_if_small(bad, MAX_BROADCAST_ROWS), same, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 5) AS width, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
grams AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, (SELECT DISTINCT width FROM items) WHERE len(w) >= width))
SELECT g.doc_id, i.item_id, count(*) AS n_shared, any_value(s.n) AS n_item
FROM grams g JOIN items i ON g.width = i.width AND g.gram = i.gram JOIN sizes s ON s.item_id = i.item_id
GROUP BY g.doc_id, i.item_id HAVING count(*) * 100 >= 80 * any_value(s.n)
"""

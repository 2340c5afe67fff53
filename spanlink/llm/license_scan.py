"""License scans by diagonal voting.

All rolling k-grams of the words of a whole text are joined, as hashes, to their positions in the license templates. A hit
votes for the diagonal (document position - template position). Diagonals of one text and template that lie within `near`
words of each other and whose hits touch are merged into a span, which is verified by the share of the template's grams
that the span holds. A verified span adds the template's label. Phrases of the base rule are found beside it and always
keep their labels.

Inputs: a null text is empty; texts without words have zero counts, no labels and score 0; rows are told apart by doc_id and
a hash of the text, so rows that repeat a doc_id are scanned each on their own and equal rows get equal results; null doc_ids
are scanned too. Spans of several templates over the same words all count. Other columns are ignored. Empty tables give empty
tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize
from .grams import gram_keys, word_keys

#: Phrase -> label of the base rule.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label -> license sentences that are looked for.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("reserved", "all rights reserved"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, NEAR, SHARE = 3, 3, 0.6
MAX_BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def template_grams(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, at, h, n): position and hash of each gram of each template, and their number."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    grams = rows.select("template", "label", gram_keys(word_keys(words_of(F.col("text"))), k).alias("g"))
    return grams.select("template", "label", F.size("g").alias("n"), F.posexplode("g").alias("at", "h"))


def spans(words: DataFrame, templates: DataFrame, k: int = K, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """Verified spans (row, template, label, first_word, last_word, votes, covered) of a table (row, words)."""
    keys = words.select("row", word_keys(F.col("words")).alias("keys"))
    rolling = keys.select("row", F.posexplode(gram_keys(F.col("keys"), k)).alias("pos", "h"))
    hits = rolling.join(broadcast_if_small(templates, MAX_BROADCAST_ROWS), "h")
    votes = hits.groupBy("row", "template", "label", "n", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("ats"))
    ordered = W.partitionBy("row", "template").orderBy("diagonal", "lo")
    # a neighbour continues a span when its diagonal is near and it starts where the span ends, give or take the shift
    fresh = (F.col("diagonal") - F.lag("diagonal").over(ordered) > near) | (F.abs(F.col("lo") - F.lag("hi").over(ordered)) > F.col("n") + near)
    run = F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(ordered)
    merged = votes.withColumn("run", run).groupBy("row", "template", "label", "n", "run").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("first_word"), (F.max("hi") + (k - 1)).alias("last_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("seen"))
    return merged.withColumn("covered", F.col("seen") / F.col("n")).where(F.col("covered") >= share).select("row", "template", "label", "first_word", "last_word", "votes", "covered")


def _base(words: Column, joined: Column, phrases=PHRASES) -> dict[str, Column]:
    """n_base, positions and labels of the phrases. joined: all words between single spaces, with one at each end."""
    def places(phrase: str) -> Column:
        parts = phrase.split(" ")
        test = lambda i: reduce(lambda a, b: a & b, [F.element_at(words, i + j) == p for j, p in enumerate(parts)])
        last = F.size(words) - (len(parts) - 1)
        found = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i <= last) & test(i))
        return F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))
    return {label: places(phrase) for phrase, label in phrases}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select("doc_id", F.col("text").alias("text"))
    worded = rows.select("doc_id", F.struct("doc_id", F.xxhash64("text").alias("text")).alias("row"), words_of(F.col("text")).alias("words"))
    joined = worded.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    labels = sorted({label for _, label in phrases})
    by = {}
    for (phrase, label), places in zip(phrases, _base(F.col("words"), F.col("joined"), phrases).values(), strict=True):
        by.setdefault(label, []).append(places)
    placed = joined.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), *[F.concat(*by[x]).alias(f"at_{x}") for x in labels])
    every = F.concat(*[F.col(f"at_{x}") for x in labels])
    base = placed.select(
        "doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), (F.array_min(every) - 1).cast("long").alias("first_word"), (F.array_max(every) - 1).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in labels])).alias("base"))
    template = template_grams(docs.sparkSession, templates, k)
    found = spans(worded.select("row", "words"), template, k, near, share)
    found = materialize(found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("covered").alias("covered")), "spans")
    out = base.join(broadcast_if_small(found, MAX_BROADCAST_ROWS), "row", "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("covered", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))


_VALUES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES)
#: The whole result, by grams as texts.
ORACLE = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
templates(template, label, text) AS (VALUES {_VALUES}),
split AS (SELECT template, label, regexp_extract_all(text, '{WORD}') AS w FROM templates),
wanted AS (SELECT template, label, len(w) - {K - 1} AS n, i AS spot, array_to_string(w[i:i + {K - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM split)),
rolling AS (SELECT doc_id, i AS pos, array_to_string(w[i:i + {K - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM words)),
votes AS (SELECT doc_id, template, label, n, pos - spot AS diagonal, min(pos) AS lo, max(pos) AS hi, list(DISTINCT spot) AS ats FROM rolling JOIN wanted USING (g) GROUP BY ALL),
cut AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {NEAR} AND abs(lo - lag(hi) OVER o) <= n + {NEAR} THEN 0 ELSE 1 END AS fresh FROM votes
  WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal, lo)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal, lo) AS run FROM cut),
spans AS (SELECT doc_id, label, len(list_distinct(flatten(list(ats)))) / n AS covered FROM runs GROUP BY doc_id, template, label, n, run HAVING covered >= {SHARE}),
found AS (SELECT doc_id, list(DISTINCT label) AS more, max(covered) AS covered FROM spans GROUP BY doc_id),
phrases(phrase, label) AS (VALUES {_PHRASES}),
places AS (SELECT doc_id, label, i - 1 AS spot FROM (SELECT doc_id, w, phrase, label, unnest(range(1, len(w) + 1)) AS i FROM words, phrases) WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE least(coalesce(covered, 0.0), 1.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

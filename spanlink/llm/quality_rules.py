"""Learned decision lists over native document statistics.

`statistics` computes counts of a whole text with built-in functions only. `learn` fits an ordered list of rules, each a
conjunction of thresholds, by sequential covering on labelled statistics: a rule grows on two thirds of the rows by the
condition of the largest FOIL gain, is pruned from its end on the last third while that raises its value there, and is kept
if its precision on both parts reaches `precision`; the rows it covers go and the next rule grows. `verdict` emits the list
as one ordered CASE expression. Of conditions with equal gain the first feature of FEATURES and its lowest threshold win; a value
equal to a threshold counts as above it; the first rule that holds decides.

Inputs: null texts count as empty (all counts 0, base_failed true); labels that are null are no examples; labels rows that
repeat a doc_id count once each; where no label or only one class is known the list is empty and the base rule alone
decides. Rows that repeat a doc_id are judged each on their own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACES, SPACES
from .grams import gram_keys, word_keys

WINDOW = 8
#: Labelled rows that are fitted at most; they are those with the smallest hashes of doc_id.
SAMPLE_ROWS = 4000
FEATURES = ("words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_distinct, n_lines and the columns of keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(NOT_SPACES))
    first = docs.select("doc_id", *keep, text.alias("t"))
    split = first.select("doc_id", *keep, "t", F.filter(F.split("t", SPACES + "+"), lambda w: w != "").alias("w"), lines.alias("lines"))
    counted = split.select(
        "doc_id", *keep, F.size("w").cast("long").alias("n_words"), (F.length("t") - F.regexp_count("t", F.lit(SPACES))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), word_keys(F.col("w")).alias("k"))
    grams = counted.withColumn("n_distinct", F.size(F.array_distinct("k")).cast("long")).withColumn("g", gram_keys(F.col("k"), WINDOW)).drop("k")
    # positions of windows that occur twice; only texts with such a window pay for the sort
    pairs = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = grams.withColumn("s", pairs).drop("g")
    twice = F.filter(F.transform("s", lambda x, j: F.when((F.try_element_at("s", j + 2)["h"] == x["h"]) | F.when(j > 0, F.try_element_at("s", F.when(j > 0, j).otherwise(1))["h"] == x["h"]).otherwise(F.lit(False)), x["i"])), lambda p: p.isNotNull())
    placed = sorted_.withColumn("at", F.when(F.col("s").isNotNull(), F.array_sort(twice))).drop("s")
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at("at", j + 2) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return dict(zip(FEATURES, (F.col("n_words").cast("double"), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_distinct", "n_words")), strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold


Rule = tuple[Condition, ...]


def _value(rule: Rule, rows: list[dict], labels: list[int]) -> tuple[int, int]:
    hit = [y for r, y in zip(rows, labels, strict=True) if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[dict], labels: list[int], most: int) -> Rule:
    from math import log2

    rule: Rule = ()
    while len(rule) < most and (neg := len(labels) - sum(labels)) and (pos := sum(labels)):
        before, best = log2(pos / (pos + neg)), (0.0, None)
        for name in FEATURES:
            order = sorted(zip((r[name] for r in rows), labels, strict=True))
            p, step = 0, max(1, len(order) // 64)
            for i, (x, y) in enumerate(order):
                if i and i % step == 0 and x > order[i - 1][0]:
                    for above, good, n in ((False, p, i), (True, pos - p, len(order) - i)):
                        gain = good * (log2(good / n) - before) if good else 0.0
                        if gain > best[0] + 1e-9:
                            best = gain, Condition(name, above, (x + order[i - 1][0]) / 2)
                p += y
        if best[1] is None:
            break
        rule += (best[1],)
        keep = [i for i, r in enumerate(rows) if best[1].holds(r)]
        rows, labels = [rows[i] for i in keep], [labels[i] for i in keep]
    return rule


def cover(rows: list[dict], labels: list[int], rules: int = 8, conditions: int = 3, precision: float = 0.95, support: int = 5) -> list[Rule]:
    """The decision list for label 1, by sequential covering; rows come in a fixed order and every third one only prunes."""
    grow = [(r, y) for i, (r, y) in enumerate(zip(rows, labels, strict=True)) if i % 3]
    prune = [(r, y) for i, (r, y) in enumerate(zip(rows, labels, strict=True)) if i % 3 == 0]
    found: list[Rule] = []
    worth = lambda rule, part: (lambda p, n: ((p - n) / (p + n) if p + n else -1.0, p))(*_value(rule, [r for r, _ in part], [y for _, y in part]))
    while len(found) < rules and any(y for _, y in grow):
        rule = _grow([r for r, _ in grow], [y for _, y in grow], conditions)
        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule = rule[:-1]
        (p, n), (q, m) = (_value(rule, [r for r, _ in part], [y for _, y in part]) for part in (grow, prune))
        if not rule or p < support or p < precision * (p + n) or q < precision * (q + m):
            break
        found.append(rule)
        grow, prune = ([x for x in part if not all(c.holds(x[0]) for c in rule)] for part in (grow, prune))
    return found


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> list[Rule]:
    """Rules that cover labels.quality = 0, from at most sample_rows labelled documents."""
    usable = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").alias("y"), F.xxhash64("doc_id", F.lit(5)).alias("o"))
    chosen = usable.orderBy("o", "doc_id", "y").limit(sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the limit bounds the broadcast
    # base_failed is a column here and no filter: pushed below the projections, a filter would repeat their expressions
    got = statistics(known, "y", "o").select("o", "doc_id", "y", base_failed().alias("out"), *[c.alias(n) for n, c in features().items()]).orderBy("o", "doc_id", "y").limit(sample_rows).collect()
    got = [r for r in got if not r["out"]]
    rows = [{n: float(r[n]) for n in FEATURES} for r in got]
    return cover(rows, [int(r["y"] == 0) for r in got], **options)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that fired, from 1; 0: the base rule, null: none) as ordered conditional expressions."""
    at = features()
    kept, fired = F.when(base_failed(), F.lit(False)), F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & (at[c.feature] >= c.threshold if c.above else at[c.feature] < c.threshold)
        kept, fired = kept.when(holds, F.lit(False)), fired.when(holds, F.lit(i))
    return kept.otherwise(F.lit(True)), fired.otherwise(F.lit(None).cast("int"))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    kept, fired = verdict(rules)
    return statistics(docs).withColumns({"base_failed": base_failed(), "kept": kept, "rule": fired})

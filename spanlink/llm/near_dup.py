"""MinHash near-duplicate groups by tensored banding.

Two small collections of half keys are computed for each document: U and V, each of `halves` keys of `rows` MinHash values.
A table of the index is a pair (u, v), so halves * halves tables of 2 * rows values cost only 2 * halves * rows MinHash
values. A pair of similarity s meets in some table with probability (1 - (1 - s^rows)^halves)^2: with 3 rows and 10 halves
0.9998 at s = 0.85 and 0.9985 at 0.80, with 14 halves 0.9999 at 0.80.
A half key that only one text has cannot be part of a shared table and is dropped before tables are formed.

Inside a bucket pairs are not enumerated: each round compares all members with one leader, on full shingle sets. Only
buckets whose members are still in different components go on, with the member nearest to earlier leaders as the next
leader. What is left after `rounds` leaders goes through an exact prefix filter on full shingle sets, so no link of
texts that met is lost: the links that are lost are those of texts that meet in no table and have no path of links.

Inputs: null, empty and blank texts have the empty set and are linked with nothing; equal sets are one class before any
hashing, whatever the group's size; rows that repeat a doc_id count as one document with the smallest of their
texts and give one row; rows without a doc_id are linked with nothing (component null, kept). Other columns are ignored,
so their names cannot clash. Empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, lean, materialize
from .components import components
from .hashing import mix, shingle_sets

ROWS, HALVES, ROUNDS = 3, 10, 2
#: A broadcast side has at most so many ids (about 30 bytes each in memory); above that the join is shuffled.
MAX_BROADCAST_IDS = 500_000
#: Classes of so many equal sets get their smallest doc_id by a broadcast; texts in more pairs than this are compared by several tasks.
HOT = 512
_rng = np.random.Generator(np.random.PCG64(977))
_XOR = _rng.integers(1, 2**64, 4096, dtype=np.uint64)
_ODD = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)

SKETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n", "d1", "d2")] + [T.StructField("halves", T.ArrayType(T.LongType()))])


def _min_hashes(grams: np.ndarray, count: int) -> np.ndarray:
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        np.minimum(low, ((grams[None, at : at + 4096] ^ _XOR[:count, None]) * _ODD[:count, None]).min(axis=1), out=low)
    return low


def _half_keys(grams: np.ndarray, rows: int, halves: int) -> np.ndarray:
    low = mix(_min_hashes(grams, 2 * halves * rows).reshape(2 * halves, rows))
    keys = np.arange(2 * halves, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * _ODD[0] + low[:, r])
    return keys.view(np.int64)


def sketches(docs: DataFrame, k: int, rows: int, halves: int) -> DataFrame:
    """doc_id, set size n, 128-bit digest of the set, half keys (null for the empty set)."""

    def run(batches):
        for batch in lean(batches):
            n, d1, d2, keys = [], [], [], []
            for grams in shingle_sets(batch.column(1), k):
                n.append(len(grams))
                d1.append(int(mix(grams ^ _XOR[-1]).sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(mix(grams * _ODD[-1])).astype(np.int64)) if len(grams) else 0)
                keys.append(_half_keys(grams, rows, halves) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=SKETCH.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _similar(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with their similarity on full sets and whether they are linked.

    Texts of no pair are left out before the shuffle as long as the ids to keep are few enough to broadcast. A pair takes the
    text of its end that is in fewer pairs along to the other end. Pairs of a text in more than HOT pairs are dealt to several
    tasks, HOT each, and its text is copied once for each of these; its set is made once for the pairs of a batch.
    """
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    degree = materialize(ends.groupBy("doc_id").agg(F.count("*").alias("times")), "degrees")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(degree.select("doc_id"), MAX_BROADCAST_IDS), "doc_id", "left_semi")
    hot = degree.where(F.col("times") > HOT).select("doc_id", F.ceil(F.col("times") / HOT).cast("int").alias("parts"))
    hot = broadcast_if_small(hot, MAX_BROADCAST_IDS)
    known = pairs.join(hot.select(F.col("doc_id").alias("a"), F.col("parts").alias("pa")), "a", "left").join(hot.select(F.col("doc_id").alias("b"), F.col("parts").alias("pb")), "b", "left")
    turn = F.coalesce("pb", F.lit(1)) > F.coalesce("pa", F.lit(1))
    dealt = known.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("end"), F.greatest(F.coalesce("pa", F.lit(1)), F.coalesce("pb", F.lit(1))).alias("parts"))
    dealt = dealt.select("hub", "end", F.pmod(F.xxhash64("end"), F.col("parts")).cast("int").alias("part"))
    carried = dealt.join(texts.select(F.col("doc_id").alias("end"), F.col("text").alias("te")), "end")
    hubs = texts.join(hot, "doc_id", "left").select(F.col("doc_id").alias("hub"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("text").alias("th"))
    both = carried.join(hubs, ["hub", "part"]).select("hub", "end", "th", "te")

    def run(batches):
        last, mine = None, None
        for batch in lean(batches):
            jac, linked = [], []
            for hub, th, gb in zip(batch.column(0).to_pylist(), batch.column(2), shingle_sets(batch.column(3), k), strict=True):
                if hub != last:
                    last, mine = hub, next(shingle_sets(pa.array([th.as_py()], pa.string()), k))
                ga = mine
                common = np.intersect1d(ga, gb, assume_unique=True).size
                union = len(ga) + len(gb) - common
                jac.append(common / max(1, union))
                linked.append(union > 0 and 100 * common >= percent * union)
            a, b = (f(batch.column(0), batch.column(1)) for f in (pc.min_element_wise, pc.max_element_wise))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(jac, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "jac", "linked"])

    checked = materialize(both.mapInArrow(run, "a long, b long, jac double, linked boolean"), "checked")
    discard(degree)
    return checked


def _near_sizes(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes differ more than this cannot reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _tables(reps: DataFrame) -> DataFrame:
    """(tk, rep, n): the index rows of buckets with two members or more."""
    half = reps.select("rep", "n", F.posexplode("halves").alias("side", "key"))
    shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    half = half.join(shared, "key", "left_semi")
    halves = F.max(F.size("halves")).alias("w")
    width = reps.agg(halves).first()["w"] or 0
    u = F.collect_list(F.when(F.col("side") < width // 2, F.col("key"))).alias("u")
    v = F.collect_list(F.when(F.col("side") >= width // 2, F.col("key"))).alias("v")
    sides = half.groupBy("rep", "n").agg(u, v)  # at most `halves` keys a side
    rows = sides.select("rep", "n", F.explode("u").alias("u"), "v").select("rep", "n", "u", F.explode("v").alias("v"))
    return rows.select(F.xxhash64("u", "v").alias("tk"), "rep", "n")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, rows: int = ROWS, halves: int = HALVES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with an equal set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch, unique = materialize(sketches(docs, k, rows, halves), "sketches"), None
    known = sketch.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = unique = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(docs.where("doc_id is null")), "unique")
        discard(sketch)
        sketch = materialize(sketches(docs, k, rows, halves), "sketches")
        known = sketch.where("doc_id is not null")
    classes = materialize(known.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    reps = known.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "halves")
    comps = _link(docs, reps, k, percent, rounds)
    # sets that stand alone need no look-up; a large class is looked up where its documents are, not in one task
    digest, known = ["n", "d1", "d2"], known.select("doc_id", "n", "d1", "d2")
    large = broadcast_if_small(classes.where(F.col("c") >= HOT).select(*digest, "rep"), MAX_BROADCAST_IDS)
    small = classes.where(F.col("c").between(2, HOT - 1)).select(*digest, "rep")
    looked = known.join(large, digest).unionByName(known.join(large, digest, "left_anti").join(small, digest, "left"))
    with_class = looked.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("class_id"))
    joined = with_class.join(comps.select(F.col("id").alias("class_id"), "comp"), "class_id", "left") if comps is not None else with_class.withColumn("comp", F.lit(None).cast("long"))
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "class_id").alias("component_id"), "class_id")
    out = out.unionByName(sketch.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id")))
    groups = materialize(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id"), "groups")
    discard(sketch, unique, classes, comps)
    return groups


def _link(docs: DataFrame, reps: DataFrame, k: int, percent: int, rounds: int) -> DataFrame | None:
    """Components of the linked representatives, or None where no pair meets."""
    open_rows = materialize(_tables(reps).withColumn("comp", F.col("rep")), "tables")
    edges = labels = None
    rounds_checked: list[DataFrame] = []
    for r in range(rounds + 1):
        if r < rounds:
            pairs = _leader_pairs(open_rows, rounds_checked, percent)
        else:
            pairs = _prefix_pairs(docs, open_rows.groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), k, percent)
        if rounds_checked:
            pairs = pairs.join(reduce(DataFrame.unionByName, [c.select("a", "b") for c in rounds_checked]), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            discard(pairs)
            if open_rows.isEmpty():
                break
            continue
        checked = _similar(pairs, docs, k, percent)
        discard(pairs)
        rounds_checked.append(checked)
        linked = checked.where("linked").select("a", "b")
        edges = linked if edges is None else edges.unionByName(linked)
        discard(labels)
        labels = components(edges)
        if r == rounds:
            break
        relabelled = open_rows.drop("comp").join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        split = relabelled.groupBy("tk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tk")
        left = materialize(relabelled.join(split, "tk", "left_semi").select("tk", "rep", "n", "comp"), "open")
        discard(open_rows)
        open_rows = left
    discard(open_rows, *rounds_checked)
    return labels


def _prefix_pairs(docs: DataFrame, rest: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of rest (rep, n, comp) in different components that can be linked, by an exact prefix filter.

    Sets of x and y shingles are linked when (100 + percent) * common >= percent * (x + y). Each set's shingles are ordered by
    ascending frequency; those that one text alone has come first and match nothing, so passages that many texts share,
    which come last, make no pairs. Behind a linked pair's first common shingle, itself included, both sets must have enough
    shingles left: the join asks this of every shingle it meets on. A set meets smaller sets with a longer
    prefix and larger sets with a shorter one, and each pair only from its larger side.
    """
    rest = materialize(rest, "rest")
    ids = broadcast_if_small(rest.select(F.col("rep").alias("doc_id")), MAX_BROADCAST_IDS)

    def run(batches):
        for batch in lean(batches):
            sets = pa.array([g.view(np.int64) for g in shingle_sets(batch.column(1), k)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["rep", "hs"])

    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "rep long, hs array<long>")
    grams = materialize(sets.select("rep", F.explode("hs").alias("h")), "grams")
    shared = materialize(grams.join(grams.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h"), "shared")
    discard(grams)
    enough = (F.col("left") * 100 >= F.col("n") * percent).alias("enough")  # for the smallest partner
    sizes = shared.groupBy("rep").agg(F.count("*").alias("left")).join(rest, "rep").where(enough).select("rep", "n", "comp", "left")
    order = F.row_number().over(W.partitionBy("rep").orderBy("c", "h"))  # of one text's own shingles
    prefix = shared.join(sizes, "rep").withColumn("left", F.col("left") + 1 - order).where(enough).select("h", "rep", "n", "comp", "left")
    prefix = materialize(prefix, "prefix")
    discard(shared, rest)
    short = prefix.where(F.col("left") * (100 + percent) >= F.col("n") * (2 * percent))  # for partners as large or larger
    larger = F.expr("x.h = y.h and x.comp <> y.comp and (x.n > y.n or x.n = y.n and x.rep > y.rep)")
    met = larger & (F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent) & _near_sizes(F.col("x.n"), F.col("y.n"), percent)
    pairs = prefix.alias("x").join(short.alias("y"), met)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _leader_pairs(rows: DataFrame, checked: list[DataFrame], percent: int) -> DataFrame:
    """(a, b), a < b: each bucket's leader with the members of other components.

    The first leader is the member with the smallest hash, the same one in all buckets of a group. Later ones are the members
    nearest to the text they were compared with.
    """
    if not checked:
        order = F.struct(F.xxhash64("rep", F.lit(11)).alias("o"), "rep", "n", "comp")
    else:
        ends = [c.select(F.col(end).alias("rep"), "jac") for c in checked for end in ("a", "b")]
        rows = rows.join(reduce(DataFrame.unionByName, ends).groupBy("rep").agg(F.max("jac").alias("jac"), F.count("*").alias("times")), "rep", "left")
        # an earlier leader of a large bucket was in many pairs: it comes after the members that it was compared with
        order = F.struct((F.coalesce("times", F.lit(0)) > 8).alias("was"), (-F.coalesce("jac", F.lit(0.0))).alias("o"), F.xxhash64("rep", F.lit(12)).alias("h"), "rep", "n", "comp")
    lead = rows.groupBy("tk").agg(F.min(order).alias("lead"), F.count("*").alias("c")).where("c > 1").select("tk", "lead")
    pairs = rows.join(lead, "tk").where((F.col("comp") != F.col("lead.comp")) & _near_sizes(F.col("n"), F.col("lead.n"), percent))
    return pairs.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()


#: The whole result by comparing all documents that share a shingle: for small tables, as the compared one.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS equal FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
comps AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT b AS doc_id, min(a) AS class_id FROM links WHERE equal GROUP BY b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept, coalesce(class_id, doc_id) AS class_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN comps USING (doc_id) LEFT JOIN classes USING (doc_id)
"""

"""String and set similarities. Set measures, edit distance and lengths are built-in; the rest share one Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over one integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, clipped windows at both ends included."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0 if b else 1.0
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with each side's rest; 1 where one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not p or not q):
        return 1.0
    left, right = f"{common} {p}".strip(), f"{common} {q}".strip()
    found = [ratio(left, right)]
    if common:
        found += [ratio(common, left), ratio(common, right)]
    return max(found)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 1.0
    return partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if long < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if long <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a and not b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


_KINDS = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "jaro": jaro_winkler, "weighted": weighted_ratio}


def fuzzy(a: Column, b: Column, *kinds: str) -> Column:
    """A struct of the named similarities, all from one Arrow UDF; 0 where a side is empty."""
    wanted = [(k, _KINDS[k]) for k in kinds]

    @F.pandas_udf(", ".join(f"{k} double" for k in kinds))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for p, q in zip(x, y, strict=True):
            if (got := known.get((p, q))) is None:
                got = known[p, q] = tuple(f(p, q) if p and q else 0.0 for _, f in wanted)
            rows.append(got)
        return pd.DataFrame(rows, columns=[k for k, _ in wanted])

    return run(a, b)


def _one(kind: str):
    return lambda a, b: fuzzy(a, b, kind)[kind]


ratio_col, partial_ratio_col, token_sort_col, token_set_col, jaro_col, weighted_col = map(_one, ("ratio", "partial", "token_sort", "token_set", "jaro", "weighted"))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a), F.length(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

"""Language identification with interpolated Kneser-Ney character models.

For each language the n-grams (n = 1 to ORDER) of the padded words of its training texts are counted; lower orders use
continuation counts, all orders one absolute discount, the order below takes over what is discounted, and below the single
characters is the uniform distribution over all characters of the training texts and one unknown one, so the probabilities
after any context sum to one. All languages share one sorted array of 64-bit n-gram hashes for each order, with a row of
discounted probabilities and back-off weights per n-gram. A text's cross-entropy is the mean over all its characters, word
by word, so each distinct word is scored once and remembered. The language of lowest cross-entropy wins, of equal ones the
first by name; the confidence is a softmax over cross-entropies whose scale is calibrated on texts that were not counted.

Rejection is calibrated on the same texts, by the cross-entropy with each word in its own best language, so a text of several
known languages is not rejected. Of each language's texts these have a median and a spread, which for a text of n characters is
that of texts plus that of characters over n; both are taken from quartiles, so single odd texts do not move them. A text is
rejected when its value is more than REJECT spreads above its language's median, or its confidence is below `min_confidence`. `identify` tells rejected texts in a column of their own, or as `und` on request.

Training uses a bounded sample: about SAMPLE_DOCS texts of each language, those with the smallest hashes of doc_id.

Inputs: null and letterless texts are und with score 0; rows with a blank text or without lang are no examples; with no example at
all every text is und; rows that repeat a doc_id are each predicted; other columns are ignored; empty tables give empty
tables.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import lean
from .hashing import slices

ORDER = 4
SAMPLE_DOCS = 400
#: A language of fewer texts counts all of them.
HOLD_FROM = 20
#: Spreads above its language's median at which a text is rejected.
REJECT = 20.0
CACHE_WORDS = 80_000
_LETTER = regex.compile(r"\p{L}")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between a start mark 2 and an end mark 3, and the index of each start mark."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _grams(codes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n the hash of the n-gram that ends at each character; 0 where it would begin before its word."""
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    out, last = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        if n == 1:
            h = _mixed(codes * _MULT + np.uint64(1))
        else:
            h = np.zeros(len(codes), np.uint64)
            h[1:] = _mixed(last[:-1] * _MULT + codes[1:] + np.uint64(n))
        h = np.where(place >= n - 1, h | np.uint64(1), np.uint64(0))
        out.append(h)
        last = h
    return out


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # sorted hashes of each order
    share: list[np.ndarray]  # discounted probability of the n-gram, a column a language
    back: list[np.ndarray]  # weight of the order below after the n-gram as a context
    rest: np.ndarray | None = None  # probability of each character by the uniform distribution, times what single characters leave
    scale: float = 1.0
    limits: np.ndarray | None = None  # median, variance of texts, variance of characters, a row a language

    def probabilities(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each character after those before it in its word, a column a language; start marks have no meaning."""
        grams = _grams(codes, starts, len(self.keys))
        p = np.broadcast_to(self.rest, (len(codes), len(self.languages)))
        context = None
        for keys, share, back, h in zip(self.keys, self.share, self.back, grams, strict=True):
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = (keys[i] == h) & (h > 0)
            got = np.where(known[:, None], share[i], np.float32(0))
            p = got + p if context is None else np.where((h > 0)[:, None], got + context * p, p)
            weight = np.where(known[:, None], back[i], np.float32(1))
            context = np.concatenate([np.ones((1, p.shape[1]), np.float32), weight[:-1]])
        return p

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Nats of each word with its end mark, a column a language."""
        codes, starts = _codes(words)
        cost = -np.log(self.probabilities(codes, starts))
        cost[starts[:-1]] = 0  # start marks are given
        return np.add.reduceat(cost, starts[:-1], axis=0)

    def unlike(self, cost: np.ndarray, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Which texts are rejected, by their cross-entropy word by word, their best language and their length."""
        if self.limits is None:
            return np.zeros(len(best), bool)
        median, of_texts, of_chars = self.limits[best].T
        return cost > median + REJECT * np.sqrt(of_texts + of_chars / np.maximum(chars, 1))


def _next_sums(keys: np.ndarray, context: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(keys), values.shape[1]))
    at = np.searchsorted(keys, context)
    ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == context)
    np.add.at(out, at[ok], values[ok])
    return out


def fit(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """Kneser-Ney models of word counts by language."""
    languages = sorted(counts)
    found, codes_of = [], []
    for lang in languages:
        words = [w for w in sorted(counts[lang]) if w]
        codes, starts = _codes(words)
        weight = np.repeat(np.array([counts[lang][w] for w in words], np.float64), np.diff(starts))
        grams = _grams(codes, starts, order)
        per = []
        for n in range(order):
            h = grams[n]
            before = np.concatenate([np.zeros(1, np.uint64), grams[n - 1][:-1]]) if n else np.zeros(len(h), np.uint64)
            longer = None
            if n + 1 < order:  # the longer n-gram that ends at the same character
                longer = grams[n + 1]
            per.append((h, before, weight, longer))
        found.append(per)
        codes_of.append(codes)
    model = Model(languages, [], [], [])
    raw = []
    for n in range(order):
        keys = np.unique(np.concatenate([p[n][0][p[n][0] > 0] for p in found]))
        table, context = np.zeros((len(keys), len(languages))), np.zeros(len(keys), np.uint64)
        for j, per in enumerate(found):
            h, before, weight, longer = per[n]
            use = h > 0
            at = np.searchsorted(keys, h[use])
            context[at] = before[use]
            if n == 0:  # start marks are never predicted; they stay as contexts
                weight = np.where(codes_of[j] == 2, 0.0, weight)
            if longer is None:
                np.add.at(table[:, j], at, weight[use])
            else:
                # continuation count: distinct characters before the n-gram; at a word's start, its count
                has = longer[use] > 0
                pairs = np.unique(longer[use][has], return_index=True)[1]
                np.add.at(table[:, j], at[has][pairs], 1.0)
                np.add.at(table[:, j], at[~has], weight[use][~has])
        raw.append((keys, context, table))
    for n, (keys, context, table) in enumerate(raw):
        discount = np.array([(lambda a, b: a / (a + 2 * b) if a else 0.5)((c == 1).sum(), (c == 2).sum()) for c in table.T])
        less = np.maximum(table - discount, 0)
        if n == 0:
            share = less / np.maximum(table.sum(0), 1)
            kinds = (table > 0).sum(0)
            alphabet = (table.sum(1) > 0).sum() + 1
            model.rest = (np.where(kinds > 0, discount * kinds / np.maximum(table.sum(0), 1), 1.0) / alphabet).astype(np.float32)
        else:
            below = raw[n - 1][0]
            total = _next_sums(below, context, table)
            kinds = _next_sums(below, context, (table > 0).astype(float))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            model.back.append(back.astype(np.float32))
            at = np.minimum(np.searchsorted(below, context), len(below) - 1)
            share = less / np.maximum(total[at], 1e-9)
        model.keys.append(keys)
        model.share.append(share.astype(np.float32))
    model.back.append(np.ones_like(model.share[-1]))
    return model


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Scorer:
    """Mean nats a character of whole texts; distinct words are scored once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        parts = [self.model.word_costs(words[at : at + 10_000]) for at in range(0, len(words), 10_000)]
        self.known.update(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.concatenate([self.table, *parts])

    def costs(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean nats a character, a column a language; the same with each word in its best language; the number of characters, word ends included."""
        out, length = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        least = np.zeros(len(texts))
        counted = [Counter(tokens(t)) for t in texts]
        fresh = list(dict.fromkeys(w for c in counted for w in c if w not in self.known))
        if fresh:
            if len(self.known) + len(fresh) > CACHE_WORDS:  # then all words of these texts are learned anew
                fresh, self.known, self.table = list(dict.fromkeys(w for c in counted for w in c)), {}, self.table[:0]
            self._learn(fresh)
        for i, c in enumerate(counted):
            if c:
                n = np.fromiter(c.values(), np.float64, len(c))
                length[i] = sum((len(w) + 1) * k for w, k in c.items())
                costs = self.table[np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))]
                out[i] = n @ costs / length[i]
                least[i] = n @ costs.min(axis=1) / length[i]
        return out, least, length

    def predict(self, texts: list, min_confidence: float = 0.0) -> tuple[list[str], list[float], list[bool]]:
        """Language, confidence and whether the text is rejected."""
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cost, least, length = self.costs(texts)
        weight = np.exp(-self.model.scale * (cost - cost.min(axis=1, keepdims=True)))
        sure = weight.max(axis=1) / weight.sum(axis=1)
        best = cost.argmin(axis=1)
        odd = self.model.unlike(least, best, length) | (sure < min_confidence)
        lang, score, rejected = [], [], []
        for t, b, s, r in zip(texts, best, sure, odd, strict=True):
            ok = t is not None and _LETTER.search(t) is not None
            lang.append(self.model.languages[b] if ok else "und")
            score.append(float(s) if ok else 0.0)
            rejected.append(bool(r) or not ok)
        return lang, score, rejected


def calibrate(model: Model, texts: list[str], langs: list[str]) -> None:
    """Softmax scale of the highest likelihood, and the rejection limits, from texts that were not counted."""
    known = [(t, l) for t, l in zip(texts, langs, strict=True) if l in model.languages and _LETTER.search(t)]
    if not known:
        return
    cost, least, length = Scorer(model).costs([t for t, _ in known])
    right = np.array([model.languages.index(l) for _, l in known])
    gap = cost - cost.min(axis=1, keepdims=True)
    at = lambda s: (-s * gap[np.arange(len(right)), right] - np.log(np.exp(-s * gap).sum(axis=1))).sum()
    model.scale = float(max((2.0**i for i in range(-2, 8)), key=at))
    model.limits = np.tile([np.inf, 0.0, 0.0], (len(model.languages), 1))  # a language without such texts rejects none
    for j in range(len(model.languages)):
        c, n = least[right == j], length[right == j]
        if len(c) >= 4:
            short = n <= np.median(n)
            spread = lambda x: max(np.subtract(*np.quantile(x, (0.75, 0.25))) / 1.35, 0.02) ** 2
            of_chars = max(0.0, spread(c[short]) - spread(c[~short] if (~short).any() else c)) * np.median(n[short])
            model.limits[j] = np.median(c), spread(c), max(of_chars, 1.0)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> Model:
    """A model of about sample_docs texts a language; one in five of them only calibrates, in languages of HOLD_FROM texts or more."""
    known = docs.where(F.col("text").rlike(r"(?U)\S") & F.col("lang").isNotNull()).select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id"), F.lit(3)).alias("o"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], [], [], [])
    # a hash threshold picks about the wanted number in each language, with no sort of a whole language
    part = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])[F.col("lang")]
    chosen = known.where((F.pmod("o", F.lit(1 << 30)) / float(1 << 30)) < part)
    held = (F.pmod(F.xxhash64("o"), F.lit(5)) == 0) & F.col("lang").isin([lang for lang, n in sizes.items() if n >= HOLD_FROM])

    def count(batches):
        for batch in lean(batches):
            got = Counter((lang, w) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in tokens(t))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in got], pa.string()), "w": pa.array([x for _, x in got], pa.string()), "n": pa.array(list(got.values()), pa.int64())})

    ship(docs.sparkSession)
    words = chosen.where(~held).select("lang", "text").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for r in words.toLocalIterator():  # the words of the sample
        counts[r["lang"]][r["w"]] = r["n"]
    model = fit({lang: c for lang, c in counts.items() if c}, order)
    rows = chosen.where(held).select("text", "lang").collect()  # a fifth of the sample
    calibrate(model, [r["text"] for r in rows], [r["lang"] for r in rows])
    return model


def identify(docs: DataFrame, model: Model, min_confidence: float = 0.0, reject: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with lang_pred, score and rejected; with reject, rejected texts are und with score 0."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    chosen = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)]) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in lean(batches):
            texts, lang, score, rejected = batch.column(len(keep)), [], [], []
            for _, part in slices(texts):
                for found, column in zip(scorer.predict(part.to_pylist(), min_confidence), (lang, score, rejected), strict=True):
                    column += found
            if reject:
                lang, score = ["und" if r else x for x, r in zip(lang, rejected)], [0.0 if r else x for x, r in zip(score, rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, schema)

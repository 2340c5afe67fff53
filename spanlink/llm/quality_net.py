"""A byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes. Each byte is embedded; FILTERS filters of WIDTH bytes slide byte by byte over the whole text. The text
is cut into chunks of CHUNK bytes that overlap by WIDTH - 1 bytes, so every window lies in exactly one chunk. Each filter is
max-pooled over a chunk's windows. The text's features are, for each filter, the mean of its chunks' maxima and the largest of
them; a logistic layer combines these into one probability. Embedding, filters and that layer are learned together by Adam;
gradients reach the windows that the maxima came from. Class weights are even and the probability is calibrated (Platt) on
rows that were left out of the training. Texts are worked on AT_ONCE chunks at a time, in training and in scoring, so a text
of any length needs little more memory than itself.

Training uses a bounded sample: SAMPLE_ROWS labelled texts at most, half of each label where there are enough, those with the
smallest hashes of doc_id; in this order each is taken as long as all together have at most SAMPLE_BYTES bytes. Length alone
leaves no text out unless it is longer than what is left of that bound.

Inputs: a null text is an empty one, which is scored by its (zero) features like any other; labels that are null are no
examples; with no example or one class only, the score of every text is the share of label 1 (0.5 with none). A score equal to
the threshold counts as 1. Rows that repeat a doc_id are each scored; other columns are ignored; empty tables give empty
tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .hashing import slices, text_buffer

SAMPLE_ROWS, SAMPLE_BYTES = 1600, 8 << 20
DIM, WIDTH, FILTERS, CHUNK = 4, 8, 16, 512
STEP = CHUNK - WIDTH + 1
#: Chunks that are evaluated at once.
AT_ONCE = 32


@dataclass
class Net:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _windows(body: np.ndarray) -> np.ndarray:
    """All windows of one text as a view, (windows, WIDTH) byte values, at least one; zero bytes fill a shorter text."""
    padded = body if len(body) >= WIDTH else np.concatenate([body, np.zeros(WIDTH - len(body), np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)


def pooled(net: Net, body: np.ndarray, places: bool = False):
    """Each chunk's maximum of each filter, (chunks, FILTERS), and with places the window that each came from."""
    windows = _windows(body)
    high, where = [], []
    for at in range(0, len(windows), STEP * AT_ONCE):
        part = windows[at : at + STEP * AT_ONCE]
        act = net.embed[part].reshape(len(part), WIDTH * DIM) @ net.conv
        cuts = np.arange(0, len(part), STEP)
        high.append(np.maximum.reduceat(act, cuts, axis=0))
        if places:
            where.append(np.stack([act[c : c + STEP].argmax(axis=0) + c for c in cuts]) + at)
    top = np.maximum(np.concatenate(high) + net.bias, 0)
    return (top, np.concatenate(where), windows) if places else top


def row_of(net: Net, body: np.ndarray) -> np.ndarray:
    """Mean and largest of the chunks' maxima of each filter."""
    top = pooled(net, body)
    return np.concatenate([top.mean(axis=0), top.max(axis=0)])


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, step: int, rate: float) -> None:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (grad - m)
    v += 0.01 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


def fit(bodies: list[np.ndarray], labels: list[int], epochs: int = 6, steps: int = 320, batch: int = 16, rate: float = 0.02, seed: int = 3) -> Net:
    """Learned in `epochs` passes, or more where the sample is so small that these have fewer than `steps` batches."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    net = Net(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.3, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32))
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * len(train)
    learned, state, step, cols = ("embed", "conv", "bias", "out", "base"), {}, 0, np.arange(FILTERS)
    epochs = max(epochs, -(-steps * batch // len(train)))
    for epoch in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            grads = {k: np.zeros_like(getattr(net, k)) for k in learned}
            part = order[at : at + batch]
            for i in part:
                top, where, windows = pooled(net, bodies[i], True)
                row = np.concatenate([top.mean(axis=0), top.max(axis=0)])
                p = 1 / (1 + np.exp(-np.clip(row @ net.out + net.base[0], -30, 30)))
                g = np.float32((p - y[i]) * weight[i] / len(part))
                grads["out"] += g * row
                grads["base"] += g
                d = np.repeat((g * net.out[:FILTERS] / len(top))[None], len(top), axis=0)
                d[top.argmax(axis=0), cols] += g * net.out[FILTERS:]
                d *= top > 0
                grads["bias"] += d.sum(axis=0)
                hit = windows[where]  # (chunks, FILTERS, WIDTH) bytes
                x = net.embed[hit].reshape(*where.shape, WIDTH * DIM)
                grads["conv"] += np.einsum("cfx,cf->xf", x, d)
                dx = (d[:, :, None] * net.conv.T[None]).reshape(-1, DIM)
                flat = hit.reshape(-1)
                for j in range(DIM):
                    grads["embed"][:, j] += np.bincount(flat, dx[:, j], 256).astype(np.float32)
            step += 1
            for k in learned:
                _adam(state, k, getattr(net, k), grads[k] + np.float32(1e-4) * getattr(net, k), step, rate * (1 - epoch / epochs))
    logit = np.array([row_of(net, bodies[i]) @ net.out + net.base[0] for i in np.flatnonzero(held)], np.float64)
    if held.any() and y[held].min() < y[held].max():
        slope, shift = _logistic(logit[:, None], y[held], np.ones(held.sum()))
        if slope > 0:
            net.slope, net.shift = float(slope), float(shift)
    return net


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the intercept, last, is not penalised."""
    x = np.hstack([z, np.ones((len(z), 1))])
    coef, penalty = np.zeros(x.shape[1]), np.diag([ridge] * z.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ coef)
        coef = coef - step
        if np.abs(step).max() < 1e-6:
            break
    return coef


def scores(net: Net, texts: pa.Array) -> list[float]:
    if net.constant is not None:
        return [net.constant] * len(texts)
    out = []
    for _, part in slices(texts):
        body, offsets = text_buffer(part)
        rows = np.stack([row_of(net, body[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        logit = rows @ net.out + net.base[0]
        out += (1 / (1 + np.exp(-np.clip(net.slope * logit + net.shift, -30, 30)))).astype(float).tolist()
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, **options) -> Net:
    """A net of at most sample_rows labelled texts with at most sample_bytes bytes in all, in the order of hashes of doc_id."""
    usable = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id", F.lit(7)).alias("o"))
    parts = [usable.where(F.col("y") == v).orderBy("o", "doc_id").limit(sample_rows // 2) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # the limits bound it
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("t")).join(chosen, "doc_id")
    sizes = rows.select("o", "doc_id", "y", "t", "size").orderBy("o", "doc_id", "y", "t").limit(sample_rows).collect()
    taken, left = {}, sample_bytes
    for r in sizes:
        if r["size"] <= left:
            taken[r["doc_id"], r["t"]] = None
            left -= r["size"]
    wanted = docs.sparkSession.createDataFrame(list(taken) or [(0, 0)], "doc_id long, t long")  # sample_rows rows at most
    found = rows.join(F.broadcast(wanted), ["doc_id", "t"], "left_semi").select("o", "doc_id", "y", "t", "text").dropDuplicates(["doc_id", "y", "t"]).collect() if taken else []
    found = sorted(found, key=lambda r: (r["o"], r["doc_id"], r["y"], r["t"]))
    return fit([np.frombuffer(r["text"].encode(), np.uint8) for r in found], [r["y"] for r in found], **options)


def score(docs: DataFrame, net: Net, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few kB
    chosen = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("__text").schema) + ", score double, predicted int"

    def run(batches):
        for batch in lean(batches):
            s = scores(shared.value, batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*keep, "score", "predicted"])

    return chosen.mapInArrow(run, schema)

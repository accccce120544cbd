"""Quality: positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vecclimb.llm import words as W
from vecclimb.llm.samples import held_out
from vecclimb.session import ship

SIZE = 128 + 10


def features(texts: pa.Array) -> np.ndarray:
    """A row for a text: square roots of its shares of bytes, and shares of words and lines."""
    data, offsets = W.buffers(texts)
    out = np.zeros((len(offsets) - 1, SIZE), np.float32)
    for low, high in W.slices(offsets):
        w = W.split(data, offsets[low : high + 1], W.NOT_SPACE)
        n = high - low
        size = np.diff(w.offsets)
        owner = np.repeat(np.arange(n), size)
        shares = np.bincount(owner * 128 + np.minimum(w.data, 127), minlength=128 * n).reshape(n, 128) / np.maximum(size, 1)[:, None]
        part = out[low:high]
        part[:, :128] = np.sqrt(shares)
        count = np.diff(w.bounds)
        divisor = np.maximum(count, 1)
        text = np.repeat(np.arange(n), count)
        length = w.ends - w.starts
        of = lambda x: np.bincount(text, x, minlength=n) / divisor
        same = np.zeros(len(text))
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
        first, last = w.data[w.starts], w.data[w.ends - 1] if len(text) else w.data[:0]
        capital = (first >= 65) & (first <= 90)
        symbol = (last < 128) & ~W.ALPHANUMERIC[last]
        different = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.bounds, w.bounds[1:])])
        lines = np.bincount(owner, w.data == 10, minlength=n) + 1
        part[:, 128:] = np.stack([of(length) / 10, np.log1p(count) / 10, different / divisor, of(same), of(capital), of(symbol), of(length > 20), of(length <= 2), np.log1p(count / lines) / 5, of((length >= 2) & capital[: len(text)] & (w.data[np.minimum(w.starts + 1, max(len(w.data) - 1, 0))] <= 90))], axis=1)
    return out


@dataclass
class Model:
    middle: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.hidden + self.shift) @ self.weights + self.bias


def risk(params: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """(prior R+, U- - prior R-, gradients) of positives p and unlabelled texts u, with the sigmoid loss.

    R+ is the loss of positives as positive, R- their loss as negative and U- that of unlabelled texts as
    negative. The gradients are those of the sum of both parts, or, where the second is negative, of
    its opposite alone, which brings it back to zero.
    """
    x, n = np.concatenate([p, u]), len(p)
    h = np.tanh(x @ params[0] + params[1])
    z = np.clip(h @ params[2] + params[3][0], -30, 30)
    sig = 1 / (1 + np.exp(-z))  # the loss of an example as negative; as positive it is 1 - sig
    slope = sig * (1 - sig)
    good, rest = prior * (1 - sig[:n]).mean(), sig[n:].mean() - prior * sig[:n].mean()
    g = np.empty(len(x))
    if rest >= 0:
        g[:n] = -2 * prior * slope[:n] / n
        g[n:] = slope[n:] / len(u)
    else:
        g[:n] = prior * slope[:n] / n
        g[n:] = -slope[n:] / len(u)
    back = np.outer(g, params[2]) * (1 - h * h)
    return good, rest, [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]


def _adam(params: list[np.ndarray], grads: list[np.ndarray], state: dict, rate: float) -> None:
    """One step of Adam; state holds the means and the number of steps."""
    t = state["t"] = state.get("t", 0) + 1
    m, v = state.setdefault("m", [np.zeros_like(p) for p in params]), state.setdefault("v", [np.zeros_like(p) for p in params])
    for i, g in enumerate(grads):
        m[i] = 0.9 * m[i] + 0.1 * g
        v[i] = 0.999 * v[i] + 0.001 * g * g
        params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, units: int = 24, epochs: int = 120, batch: int = 512, seed: int = 3) -> Model:
    """Minimise the non-negative PU risk, prior R+ + max(0, U- - prior R-), of a small network by batches."""
    rng = np.random.Generator(np.random.PCG64(seed))
    every, size = np.concatenate([positive, unlabelled]), positive.shape[1]
    middle, scale = every.mean(axis=0), every.std(axis=0) + 1e-2
    params = [rng.normal(0, 1 / np.sqrt(size), (size, units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), np.zeros(1)]
    pos, unl = (positive - middle) / scale, (unlabelled - middle) / scale
    state: dict = {}
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(pos)), rng.permutation(len(unl))
        steps = max(1, len(unl) // batch)
        for s in range(steps):
            p, u = pos[order_p[s::steps]], unl[order_u[s::steps]]
            if not len(p) or not len(u):
                continue
            _, _, grads = risk(params, p, u, prior)
            grads[0], grads[2] = grads[0] + 1e-4 * params[0], grads[2] + 1e-4 * params[2]
            _adam(params, grads, state, 5e-3 * (1 - epoch / epochs) + 2e-4)
    return Model(middle, scale, params[0], params[1], params[2], float(params[3][0]))


def _against_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300):
    """Logistic regression of being a positive and not an unlabelled text, both kinds weighing alike."""
    x = np.concatenate([positive, unlabelled])
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    x = np.concatenate([(x - middle) / scale, np.ones((len(x), 1))], axis=1)
    y = np.arange(len(x)) < len(positive)
    weight = np.where(y, 0.5 / len(positive), 0.5 / len(unlabelled))
    params, state = [np.zeros(x.shape[1])], {}
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(x @ params[0], -30, 30)))
        _adam(params, [x.T @ (weight * (chance - y)) + 1e-3 * params[0]], state, 0.05)
    return lambda z: (z - middle) / scale @ params[0][:-1] + params[0][-1]


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from no label of a negative.

    A model of one half tells the other half's positives from unlabelled texts. Above any threshold lies a share
    of the unlabelled that is at least the prior's part of the positives' share; so the least ratio of the two
    shares, where both are large enough to trust (the ratio's upper bound decides), is the prior.
    """
    half_p, half_u = np.arange(len(positive)) % 2, np.arange(len(unlabelled)) % 2
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in (0, 1):
        model = _against_unlabelled(positive[half_p != k], unlabelled[half_u != k])
        p[half_p == k], u[half_u == k] = model(positive[half_p == k]), model(unlabelled[half_u == k])
    p, u = np.sort(p), np.sort(u)
    share_p, share_u = (1 - np.searchsorted(x, p, "left") / len(x) for x in (p, u))
    doubt = sum(np.sqrt(np.log(40) / 2 / len(x)) for x in (p, u))
    best = np.argmin((share_u + doubt) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, most: int = 6000, most_unlabelled: int = 12_000) -> Model:
    """Train on documents outside the held-out fold; of labels only label 1 is used.

    Trusted positives are up to `most` texts of label 1, unlabelled texts up to `most_unlabelled` documents
    whatever their labels; of both the first by a hash of the id, of any length. The class prior is estimated
    from the two. Features are computed in the tasks; only they go to the driver. Without positives every text
    scores near 0, without other texts near 1.
    """
    ship(docs.sparkSession)
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    good = good.filter(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("y").alias("y")).filter("y = 1").select("doc_id")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out(F.col("doc_id"), folds, fold)).distinct()
    first = lambda ids, n, kind: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("kind", F.lit(kind))
    chosen = first(good, most, 1).unionByName(first(every, most_unlabelled, 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    sample = texts.join(F.broadcast(chosen), "doc_id")  # at most most + most_unlabelled ids are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, SIZE, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), flat], names=["doc_id", "kind", "x"])

    found = sample.select("doc_id", "kind", "text").mapInArrow(run, "doc_id long, kind int, x array<float>")
    # rows that share an id: one of them, the same in every run
    got = found.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    kind = got.column("kind").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, SIZE).astype(np.float64) if len(kind) else np.zeros((0, SIZE))
    positive, unlabelled = x[kind == 1], x[kind == 0]
    if min(len(positive), len(unlabelled)) < 4:
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros((SIZE, 1)), np.zeros(1), np.zeros(1), 20.0 if len(positive) else -20.0)
    return train(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., held_out, score, predicted) of every whole text, a row for a row.

    Null and empty texts score 0. Null ids are passed on, held_out being false; repeated rows are scored
    each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), F.col("text"), *keep)
    names = ["doc_id", *keep]
    kept = [rows.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            z = np.clip(sent.value.logits(features(texts)), -40, 40)
            out = np.where(np.diff(W.buffers(texts)[1]) > 0, 1 / (1 + np.exp(-z)), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out)], names=[*names, "score"])

    schema = StructType([*(rows.schema.fields[i] for i in kept), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).withColumns({"held_out": held_out(F.col("doc_id"), folds, fold), "predicted": (F.col("score") >= 0.5).cast("int")})

"""Toxicity: averaged subword embeddings with a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vecclimb.llm import words as W
from vecclimb.llm.samples import held_out, labelled_texts
from vecclimb.session import ship

#: Words of a bag: a document is cut into bags, and its most toxic bags decide.
BAG = 4
#: A bag of fewer subwords is filled up with neutral ones.
LEAST = 48
MEMO = 100_000


def subwords(words: list[str], buckets: int, least: int = 3, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of <word> and of the whole, word after word; and their counts."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    keys, owners = [], []
    code = W.mix(codes + np.uint64(1))
    for n in range(least, most + 1):
        grams = W.windows(code, n)
        inside = np.arange(len(grams)) + n <= ends[owner[: len(grams)]]
        keys.append(grams[inside])
        owners.append(owner[: len(grams)][inside])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * (np.arange(len(code), dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64) + np.uint64(1)))])
    keys.append(W.mix(sums[ends] - sums[ends - sizes]))
    owners.append(np.arange(len(words)))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (keys[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """What scoring needs of the trained model.

    The softmax of a mean of vectors depends on each subword only through vector . (w1 - w0): weights.
    """

    weights: np.ndarray
    slopes: np.ndarray
    shift: float


def _bags(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of the bags of all texts, and the texts of the bags."""
    counts = np.diff(w.bounds)
    per = -(-counts // BAG)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return w.bounds[:-1][text] + nth * BAG, text


class _WordScores:
    """Sums of subword weights and counts of subwords, by word hash."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def __call__(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        values, first, where = np.unique(w.hashes, return_index=True, return_inverse=True)
        known = values.tolist()
        fresh = [i for i, h in enumerate(known) if h not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo, fresh = {}, list(range(len(known)))
        for low in range(0, len(fresh), 20_000):
            part = fresh[low : low + 20_000]
            keys, counts = subwords([w.word(first[i]).decode("utf-8", "replace") for i in part], len(self.model.weights))
            sums = np.add.reduceat(self.model.weights[keys], np.cumsum(counts) - counts)
            self.memo.update(zip([known[i] for i in part], zip(sums.tolist(), counts.tolist())))
        table = np.array([self.memo[h] for h in known], np.float64).reshape(-1, 2)
        return table[where, 0], table[where, 1]


def _fresh(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a word differs from the one before it in its bag."""
    out = np.ones(len(hashes), bool)
    out[1:] = hashes[1:] != hashes[:-1]
    out[starts] = True
    return out


def bag_logits(w: W.Words, scores) -> tuple[np.ndarray, np.ndarray]:
    """Logits without bias of all bags, and the texts of the bags. A word said again at once counts once."""
    starts, text = _bags(w)
    if not len(starts):
        return np.zeros(0), text
    sums, counts = scores(w)
    fresh = _fresh(w.hashes, starts)
    return np.add.reduceat(sums * fresh, starts) / np.maximum(LEAST, np.add.reduceat(counts * fresh, starts)), text


class _Sample:
    """Bags of the labelled texts, as numbers of distinct words."""

    def __init__(self, texts: pa.Array, y: np.ndarray, buckets: int):
        names: dict[int, int] = {}
        spelled: list[str] = []
        words: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        text_of: list[np.ndarray] = []
        for first, w in W.each(texts, W.ALPHANUMERIC):
            values, at, where = np.unique(w.hashes, return_index=True, return_inverse=True)
            for h, i in zip(values.tolist(), at.tolist()):
                if h not in names:
                    names[h] = len(spelled)
                    spelled.append(w.word(i).decode("utf-8", "replace"))
            number = np.array([names[h] for h in values.tolist()], np.int32)[where]
            starts, text = _bags(w)
            if len(starts):
                fresh = _fresh(w.hashes, starts)
                words.append(number[fresh])
                sizes.append(np.add.reduceat(fresh.astype(np.int64), starts))
                text_of.append(first + text)
        self.buckets = buckets
        self.words = np.concatenate([np.zeros(0, np.int32), *words])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.at = np.cumsum(self.sizes) - self.sizes
        self.text = np.concatenate([np.zeros(0, np.int64), *text_of])
        self.label = y[self.text]
        parts = [subwords(spelled[i : i + 20_000], buckets) for i in range(0, len(spelled), 20_000)]
        self.keys = np.concatenate([np.zeros(0, np.int32), *(k.astype(np.int32) for k, _ in parts)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        self.starts = np.cumsum(self.counts) - self.counts

    def subwords_of(self, words: np.ndarray) -> np.ndarray:
        return self.keys[W.ranges(self.starts[words], self.counts[words])]

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Of all bags, without bias."""
        sums = np.add.reduceat(weights[self.keys].astype(np.float64), self.starts)
        return np.add.reduceat(sums[self.words], self.at) / np.maximum(LEAST, np.add.reduceat(self.counts[self.words], self.at))

    def top(self, value: np.ndarray) -> np.ndarray:
        """The bag of highest value of every text."""
        order = np.lexsort((value, self.text))
        return order[np.append(self.text[order][1:] != self.text[order][:-1], True)]

    def significance(self, y: np.ndarray) -> np.ndarray:
        """Of all bags: the most of its words' means of z-values, of a subword's texts being toxic."""
        seen = np.zeros((2, self.buckets))
        cuts = np.flatnonzero(np.append(True, self.text[1:] != self.text[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(self.text))):
            words = np.unique(self.words[self.at[a] : self.at[b - 1] + self.sizes[b - 1]])
            seen[self.label[a], np.unique(self.subwords_of(words))] += 1
        texts = np.bincount(self.label[cuts], minlength=2)
        share = seen.sum(axis=0) / texts.sum()
        z = (seen[1] / texts[1] - seen[0] / texts[0]) / np.sqrt((share * (1 - share) + 1e-6) * (1 / texts).sum())
        word = np.add.reduceat(z[self.keys], self.starts) / self.counts
        return np.maximum.reduceat(word[self.words], self.at)

    def fit(self, chosen: np.ndarray, size: int, rng: np.random.Generator, batch: int = 256) -> np.ndarray:
        """Embeddings and softmax, trained together on the chosen bags by Adagrad: vectors . (w1 - w0)."""
        vectors, vector_sum = np.zeros((self.buckets, size), np.float32), np.zeros(self.buckets, np.float32)
        softmax, soft_sum = (rng.random((size, 2), dtype=np.float32) - 0.5), np.zeros((size, 2), np.float32)
        bias, bias_sum = np.zeros(2, np.float32), np.zeros(2, np.float32)
        for low in range(0, len(chosen), batch):
            bags = chosen[low : low + batch]
            rate = 0.1 * (1 - 0.9 * low / len(chosen))
            words = self.words[W.ranges(self.at[bags], self.sizes[bags])]
            index = self.subwords_of(words)
            counts = np.add.reduceat(self.counts[words], np.cumsum(self.sizes[bags]) - self.sizes[bags])
            parts = np.maximum(counts, LEAST)[:, None].astype(np.float32)
            mean = np.add.reduceat(vectors[index], np.cumsum(counts) - counts) / parts
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(bags)), self.label[bags]] -= 1
            p /= len(bags)
            back = (p @ softmax.T).astype(np.float32) / parts
            step = mean.T @ p
            soft_sum += step * step
            softmax -= rate * step / np.sqrt(soft_sum + 1e-8)
            bias_sum += p.sum(axis=0) ** 2
            bias -= rate * p.sum(axis=0) / np.sqrt(bias_sum + 1e-8)
            order = np.argsort(index, kind="stable")
            cuts = np.flatnonzero(np.append(True, index[order][1:] != index[order][:-1]))
            rows = index[order][cuts]
            step = np.add.reduceat(np.repeat(back, counts, axis=0)[order], cuts)
            vector_sum[rows] += (step * step).mean(axis=1)
            vectors[rows] -= rate * step / np.sqrt(vector_sum[rows] + 1e-8)[:, None]
        return (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)


def train(texts: pa.Array, y: np.ndarray, buckets: int = 1 << 17, size: int = 8, most_bags: int = 40_000, seed: int = 7) -> Model:
    """Fit embeddings and softmax on labelled texts.

    A toxic text need not be toxic throughout: at first its toxic bag is the one with the word whose
    subwords are most significantly tied to the label, text by text; then the one that the model scores
    highest. Clean texts give random bags and their highest-scoring ones. Models of one half of the
    texts score the other half's bags for the calibration.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    sample = _Sample(texts, y, buckets)
    if len(set(sample.label.tolist())) < 2:
        return Model(np.zeros(buckets, np.float32), np.zeros(3), 20.0 if y.any() else -20.0)
    half = sample.text % 2
    every = np.ones(len(half), bool)

    def choose(part: np.ndarray, value: np.ndarray, least: float) -> np.ndarray:
        top = sample.top(value)
        bad = np.union1d(top[sample.label[top] == 1], np.flatnonzero((sample.label == 1) & (value > least)))
        good = np.concatenate([rng.permutation(np.flatnonzero(part & (sample.label == 0)))[:most_bags], *[top[(sample.label[top] == 0) & part[top]]] * 2])
        bad = rng.permutation(bad[part[bad]])[:most_bags]
        chosen = np.concatenate([np.repeat(bad, max(1, len(good) // max(1, 2 * len(bad)))), good])
        epochs = min(6, max(2, 2 * most_bags // max(1, len(chosen))))
        return np.concatenate([rng.permutation(chosen) for _ in range(epochs)])

    def clean_top(value: np.ndarray) -> float:
        top = sample.top(value)
        return float(np.quantile(value[top][sample.label[top] == 0], 0.99))

    value = sample.significance(y)
    value = sample.logits(sample.fit(choose(every, value, clean_top(value)), size, rng))
    apart = np.zeros(len(half))
    for k in (0, 1):
        apart[half == k] = sample.logits(sample.fit(choose(half != k, value, np.inf), size, rng))[half == k]
    weights = sample.fit(choose(every, value, clean_top(value)), size, rng)
    numbers, measures = text_measures(apart, sample.text)
    return Model(weights, *_calibrated(measures, y[numbers]))


def text_measures(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, their measures): the highest bag, the mean of the three highest, and of all.

    text numbers the texts of the bags, ascending. Missing second and third bags count as neutral.
    """
    order = np.lexsort((-value, text))
    value = value[order]
    cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    sizes = np.diff(np.append(cuts, len(text)))
    place = np.arange(len(text)) - np.repeat(cuts, sizes)
    three = np.add.reduceat(np.where(place < 3, value, 0), cuts) / 3
    return text[cuts], np.stack([value[cuts], three, np.add.reduceat(value, cuts) / sizes], axis=1)


def _calibrated(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve through (x, y), where label 1 has three tenths of the weight."""
    scale, middle = np.maximum(x.std(axis=0), 1e-9), x.mean(axis=0)
    u = np.concatenate([(x - middle) / scale, np.ones((len(x), 1))], axis=1)
    weight = np.where(y == 1, 0.3 / max(1, (y == 1).sum()), 0.7 / max(1, (y == 0).sum()))
    penalty = np.array([1e-3] * x.shape[1] + [1e-6])  # keeps separable data finite
    a = np.zeros(u.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(u @ a, -30, 30)))
        v = weight * p * (1 - p)
        step = np.linalg.solve((u * v[:, None]).T @ u + np.diag(penalty), u.T @ (weight * (p - y)) + penalty * a)
        a -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return a[:-1] / scale, float(a[-1] - (a[:-1] * middle / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, most: int = 3000, most_chars: int = 8_000_000) -> Model:
    """Train on up to `most` toxic and `most` clean labelled documents, none of the held-out fold.

    Texts may have any length; those of either label have most_chars characters together at most. They go to one
    task, which trains and gives the driver the model alone: neither texts nor the arrays of training stay there.
    train() draws up to most_bags bags of either label from them in a pass.
    """
    ship(docs.sparkSession)
    sample = labelled_texts(docs, labels, "toxic", folds, fold, most, most_chars).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        rows = pa.Table.from_batches(parts, parts[0].schema if parts else pa.schema([("text", pa.string()), ("y", pa.int32())]))
        model = train(rows.column("text"), rows.column("y").to_numpy().astype(np.int64))
        held = [pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.slopes.tolist()], pa.list_(pa.float64())), pa.array([model.shift], pa.float64())]
        yield pa.RecordBatch.from_arrays(held, names=["weights", "slopes", "shift"])

    found = sample.mapInArrow(run, "weights binary, slopes array<double>, shift double").first()
    if found is None:  # no labelled text, and no task
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    return Model(np.frombuffer(found.weights, "<f4"), np.array(found.slopes), found.shift)


def score(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., held_out, score, predicted) of every whole text, a row for a row.

    score is a probability by the most toxic bags of words, after calibration. Null and empty texts and
    texts without words score 0. Null ids are passed on, held_out being false; repeated rows are
    scored each; an empty table gives an empty result. Without labels of both kinds every text
    with words scores alike: near 1 if all labels are toxic, else near 0.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), F.col("text"), *keep)
    names = ["doc_id", *keep]
    kept = [rows.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scores = _WordScores(model)
        for batch in batches:
            out = np.zeros(len(batch))
            for first, w in W.each(batch.column(1), W.ALPHANUMERIC):
                logit, text = bag_logits(w, scores)
                if len(text):
                    numbers, measures = text_measures(logit, text)
                    out[first + numbers] = 1 / (1 + np.exp(-np.clip(measures @ model.slopes + model.shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out)], names=[*names, "score"])

    schema = StructType([*(rows.schema.fields[i] for i in kept), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).withColumns({"held_out": held_out(F.col("doc_id"), folds, fold), "predicted": (F.col("score") >= 0.5).cast("int")})

"""Held-out accuracy of the classifiers, and their edge cases."""

import os
import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from vecclimb.llm import quality, toxicity
from vecclimb.session import table

ODD = [(1, None), (2, ""), (3, " \n "), (4, "é" * 30000), (5, "plain"), (5, "plain"), (None, "no id at all")]


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()).item()


def measured(spark, module, label, d="/root/testdata/sf0.01"):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = module.score(docs, module.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert 10 < len(held) < len(rows)
    return auc(held.score.to_numpy(), held[label].to_numpy())


def test_quality_on_held_out_rows(spark):
    assert measured(spark, quality, "quality") > 0.93


def test_toxicity_on_held_out_rows(spark):
    assert measured(spark, toxicity, "toxic", "/root/testdata/sf0.1") > 0.96  # smaller tables hold out six toxic texts


def test_prior_of_known_mixtures():
    """Within 0.05, whatever the share of positives, from positives and mixtures alone."""
    rng = np.random.default_rng(1)
    draw = lambda n, at: rng.normal(at, 1, (n, 6))
    for prior in (0.2, 0.5, 0.85):
        n = int(4000 * prior)
        mixture = rng.permutation(np.concatenate([draw(n, 1.2), draw(4000 - n, -1.2)]))
        assert abs(quality.estimated_prior(draw(3000, 1.2), mixture) - prior) < 0.05


def test_gradients_are_those_of_the_risk():
    """Numeric differences, where the negative part of the risk is above zero and where it is below."""
    rng = np.random.default_rng(4)
    params = [rng.normal(0, 0.4, (5, 3)), rng.normal(0, 0.4, 3), rng.normal(0, 1, 3), np.array([0.2])]
    p, u = rng.normal(0.5, 1, (20, 5)), rng.normal(-0.5, 1, (30, 5))
    seen = set()
    for prior in (0.1, 0.99):
        for a, b in ((p, u), (u, p)):
            _, rest, grads = quality.risk(params, a, b, prior)
            value = lambda: (lambda good, part: good + part if rest >= 0 else -part)(*quality.risk(params, a, b, prior)[:2])
            seen.add(rest >= 0)
            for x, g in zip(params, grads):
                for at in np.ndindex(x.shape):
                    x[at] += 1e-6
                    above = value()
                    x[at] -= 2e-6
                    below = value()
                    x[at] += 1e-6
                    assert abs((above - below) / 2e-6 - g[at]) < 1e-6
    assert seen == {True, False}


def test_long_texts_are_sampled_too(spark):
    frame = spark.createDataFrame([(i, "word " * (50_000 if i % 2 else 2)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(20)], "doc_id long, quality int, toxic int")
    from vecclimb.llm.samples import labelled_texts

    rows = labelled_texts(frame, labels, "toxic", 5, 0, 100, 1_000_000).collect()
    assert sum(len(r.text) for r in rows if r.y == 1) == 1_000_000 and sum(r.y == 0 for r in rows) > 5


def invented(seed, n):
    """Texts of invented words; a third hold one of a few bad words, some of them misspelt."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "nu", "re", "so"]) for _ in range(rng.randrange(1, 4)))
    texts, y = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(5, 60))]
        y.append(int(rng.random() < 0.33))
        for _ in range(2 * y[-1]):
            words[rng.randrange(len(words))] = rng.choice(["grumple", "snarkfi"]) + rng.choice(["", "s", "d", "ing", "x" * rng.randrange(4)])
        texts.append(" ".join(words))
    return texts, np.array(y)


def test_toxicity_knows_misspellings(spark):
    texts, y = invented(1, 600)
    model = toxicity.train(pa.array(texts), y)
    unseen, truth = invented(2, 300)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(unseen)], "doc_id long, text string")
    got = toxicity.score(frame, model).toPandas().sort_values("doc_id")
    assert auc(got.score.to_numpy(), truth) > 0.98
    assert (got.predicted.to_numpy() == truth).mean() > 0.95


def test_edge_cases(spark):
    frame = spark.createDataFrame([(*r, 9) for r in ODD], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(5, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for known in (labels, labels.limit(0)):
            rows = module.score(frame, module.fit(frame, known)).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
            assert all(r.score == 0 for r in rows if r.doc_id in (1, 2))
            assert [r.held_out for r in rows if r.doc_id is None] == [False]
        assert module.score(frame.limit(0), module.fit(frame, labels)).count() == 0


def test_risk_is_bounded_below():
    """With as many positives as unlabelled texts of the same kind, scores stay finite and positive ones high."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, quality.SIZE)), rng.normal(-1, 1, (100, quality.SIZE))
    model = quality.train(good[:200], np.concatenate([good[200:], bad]), prior=2 / 3, epochs=40)
    assert (model.logits(good) > 0).mean() > 0.95 and (model.logits(bad) < 0).mean() > 0.95


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words of number {i} are here") for i in range(200)], "doc_id long, text string")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    model = toxicity.fit(docs, labels)
    sample = toxicity.labelled_texts(docs, labels, "toxic", 5, 0, 3000, 8_000_000).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    own = toxicity.train(sample.column("text"), sample.column("y").to_numpy().astype(np.int64))
    assert np.array_equal(model.weights, own.weights) and np.allclose(model.slopes, own.slopes) and np.isclose(model.shift, own.shift)
    none = toxicity.fit(docs.limit(0), labels)
    assert (none.shift, none.weights.any()) == (-20.0, False)
    monkeypatch.setattr(toxicity, "train", lambda texts, y: toxicity.Model(np.zeros(1, np.float32), np.zeros(3), float(os.getpid())))
    assert toxicity.fit(docs, labels).shift != os.getpid()  # neither texts nor training in the driver

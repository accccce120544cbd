import random

import pytest
from pyspark.sql import functions as F

from vecclimb.llm import near_dedup, skew
from vecclimb.llm.components import _to_least, connected_components
from vecclimb.llm.near_dedup import near_duplicates
from vecclimb.session import Workspace


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    """Components by comparing all pairs."""
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    sets = {i: shingle_set(t, n) for i, t in rows}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, words, share):
    return " ".join(rng.choice(["x", "yy", "zzz"]) + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("n,percent,rows", [(3, 85, 6), (5, 80, 5)])
def test_matches_brute_force(spark, n, percent, rows):
    rng = random.Random(n)
    docs, base = [], [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 120))] for _ in range(30)]
    for i in range(260):
        words = base[0] if i % 3 == 0 else rng.choice(base)
        docs.append((i, edited(rng, words, rng.choice([0, 0, 0.01, 0.02, 0.05, 0.3]))))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n, percent, rows=rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    docs = [(5, None), (6, ""), (7, " \t\n"), (1, "One two"), (2, "one  TWO"), (3, long), (9, long + " end"), (4, "solo"), (4, "solo"), (None, "one two"), (None, "nobody else")]
    frame = spark.createDataFrame([(*d, "bait", 1) for d in docs], "doc_id long, text string, node string, keys int")
    got = [tuple(r)[:4] for r in near_duplicates(frame, 3, 85).collect()]
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[5] == (5, 0, 5, True) and by[6] == (6, 0, 6, True) and by[7] == (7, 0, 7, True)
    assert by[1] == (1, 1, 1, True) and by[2] == (2, 1, 1, False)
    assert by[3][2:] == (3, True) and by[9][2:] == (3, False)
    assert sum(r[0] == 4 for r in got) == 2 and by[4][2:] == (4, True)
    assert {(r[2], r[3]) for r in got if r[0] is None} == {(1, False), (None, True)}
    assert len(got) == len(docs)
    assert near_duplicates(frame.limit(0), 3, 85).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    """Whatever the order of the rows, each is in the group of its own text, and one row of a group is chosen."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    docs = [(1, text("a")), (1, text("b")), (2, text("a") + " end"), (3, text("b") + " end"), (None, text("c")), (None, text("c") + " end"), (None, text("d")), (4, text("d")), (5, None), (5, None)]
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, keep=("text",)).collect()
        found = sorted((str(r.text)[:1], r.doc_id or 0, r.component_id or 0, r.kept, r.chosen) for r in rows)
        c = [x for x in found if x[0] == "c"]
        assert [x for x in found if x[0] in "abd"] == [("a", 1, 1, True, True), ("a", 2, 1, False, False), ("b", 1, 1, True, True), ("b", 3, 1, False, False), ("d", 0, 4, False, False), ("d", 4, 4, True, True)]
        assert [x[:4] for x in c] == [("c", 0, 0, True)] * 2 and sum(x[4] for x in c) == 1
        assert [x for x in found if x[0] == "N"] == [("N", 5, 5, True, True)] * 2


def test_large_buckets_and_hot_keys(spark, monkeypatch):
    """Buckets of many blocks, open members of a star, and salted keys give the same groups."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(skew, "LEAST_ROWS", 3)
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(90)]
    docs, words = [], base
    for i in range(150):  # a chain that drifts away from its start, with copies
        if i % 3:
            words = list(words)
            words[rng.randrange(len(words))] = f"x{i}"
        docs.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, bands=48, rows=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 3, 85)
    assert sum(r.chosen for r in got) == len({r.component_id for r in got})


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200 + i, 200) for i in range(30)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()))
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100 and all(found[200 + i] == 200 for i in range(30))


def test_components_of_a_hub(spark):
    """A node that half of all edges meet, whose leaves are linked among each other too, beside a chain."""
    edges = [(5, 10 + i) for i in range(6000)] + [(10 + i, 11 + i) for i in range(0, 5999, 3)] + [(20000 + i, 20001 + i) for i in range(300)] + [(6009, 20000)]
    rows = spark.createDataFrame(edges, "u long, v long").repartition(6)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tasks = [r["count"] for r in _to_least(rows, least, len(edges)).groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == len(edges) and max(tasks) < 6000 * 2 // 3  # the hub is in several tasks
        found = dict(map(tuple, connected_components(rows, Workspace(spark, "t")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 6001 + 301 and set(found.values()) == {5}

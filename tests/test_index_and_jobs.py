"""The stored index, exact search that prunes, jobs of several queries, resumed and chained jobs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecclimb.operators import knn as K
from vecclimb.operators import relations as R
from vecclimb.operators.index import VectorIndex, train
from vecclimb.plans import journal
from vecclimb.plans import search as S
from vecclimb.session import Workspace

KIND = "item_id long, external_id string, vec array<double>"


def clustered(spark, n=3000, size=24, groups=40, seed=1):
    """Vectors about centres; some of them odd."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, size))[rng.integers(0, groups, n)] * 3 + rng.normal(size=(n, size)) * 0.5
    x[11] = x[10]  # a tie
    lib = spark.createDataFrame([(i, f"e{i}", v.tolist()) for i, v in enumerate(x)], KIND)
    nan = float("nan")
    odd = [(9001, "null", None), (9002, "holds null", [1.0, None, *[0.0] * (size - 2)]), (9003, "zero", [0.0] * size), (9004, "short", [1.0, 2.0]), (9005, "nan", [nan] * size), (None, "no id", [1.0] * size)]
    queries = lib.filter("item_id % 100 = 10").select(F.col("item_id").alias("query_id"), "vec")
    strange = spark.createDataFrame([(-1, [1.0, 2.0]), (-2, None), (-3, [0.0] * size), (-4, [nan] * size)], "query_id long, vec array<double>")
    return lib, spark.createDataFrame(odd, KIND), queries.unionByName(strange)


def ranked(hits):
    return sorted((r.query_id, r["rank"], r.item_id) for r in hits.collect())


@pytest.mark.parametrize("metric", K.METRICS)
def test_stored_index(spark, metric):
    """Exact search gives knn()'s rows from some of them; codes find nine in ten from a fifth of the rows, read from their partitions alone."""
    lib, odd, queries = clustered(spark)
    path = f"{Workspace(spark, 'index').path}/a"
    VectorIndex.build(lib.filter("item_id < 2000").unionByName(odd), path, metric, cells=40, parts=8, carry=["external_id"]).append(lib.filter("item_id >= 2000"), ["external_id"])
    index = VectorIndex(spark, path)  # as another job would open it
    assert index.rows().count() == 3005
    wanted = ranked(K.knn(queries, lib.unionByName(odd), 10, metric))
    exact = index.exact(queries, 10, ["external_id"])
    assert ranked(exact.hits) == wanted
    assert exact.compared < 0.5 * exact.pairs
    assert all(r.external_id == f"e{r.item_id}" for r in exact.hits.filter("item_id < 9000").collect())

    found = index.search(queries, 10, probes=8, carry=["external_id"])
    got = ranked(found.hits)
    assert len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in wanted}) >= 0.9 * len(wanted)
    assert found.compared <= 0.2 * found.pairs and all(r.external_id == f"e{r.item_id}" for r in found.hits.filter("item_id < 9000").collect())
    cells = [r.cell for r in index.rows().select("cell").distinct().collect()]
    assert -1 in cells and len(cells) > 20
    plan = index.rows([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell", plan)
    assert {r.cell for r in index.rows([3, 5]).select("cell").distinct().collect()} <= {3, 5}


def test_index_by_named_vector_and_blocks(spark, monkeypatch):
    lib, _, queries = clustered(spark, 900)
    lib = lib.withColumn("embedding_id", F.col("item_id") % 2)
    asked = queries.filter("query_id > 0").withColumns({"embedding_id": F.col("query_id") % 3, "k": (F.col("query_id") % 4 + 1).cast("int")})
    index = VectorIndex.build(lib, f"{Workspace(spark, 'index').path}/a", "euclid", cells=12, parts=5)
    wanted = ranked(K.knn(asked, lib, metric="euclid"))
    assert ranked(index.exact(asked).hits) == wanted
    assert ranked(index.search(asked, 4, probes=12, again=200).hits) == wanted  # all is ranked again
    monkeypatch.setattr(K, "MOST_QUERIES", 4)  # blocks of queries
    assert ranked(index.search(asked, 4, probes=12, again=200).hits) == wanted
    assert ranked(index.exact(asked).hits) == wanted


def test_index_of_nothing(spark):
    _, odd, queries = clustered(spark, 100)
    for i, rows in enumerate((odd.limit(0), odd.filter("vec is null"))):
        index = VectorIndex.build(rows, f"{Workspace(spark, 'index').path}/{i}")
        assert index.search(queries).hits.count() == index.exact(queries).hits.count() == 0
        with pytest.raises(ValueError):
            index.append(odd)
    assert train(odd.limit(0), "cosine", 4, 2) is None
    with pytest.raises(ValueError):
        VectorIndex.build(odd, "unused", "other")


def test_a_broken_append_is_never_read(spark, monkeypatch):
    lib, _, queries = clustered(spark, 300)
    path = f"{Workspace(spark, 'index').path}/a"
    index = VectorIndex.build(lib.filter("item_id < 200"), path, cells=5, parts=4)
    monkeypatch.setattr("pyspark.sql.GroupedData.agg", lambda *a: 1 / 0)  # the batch is written, its counts are not
    with pytest.raises(ZeroDivisionError):
        index.append(lib.filter("item_id >= 200"))
    monkeypatch.undo()
    assert VectorIndex(spark, path).rows().count() == 200
    index.append(lib.filter("item_id >= 200"))
    assert VectorIndex(spark, path).rows().count() == 300


def test_candidates_of_many_queries_are_bounded():
    """16,384 queries and 10,000 rows in one task: what is held stays near the k best of each."""
    rng = np.random.default_rng(3)
    best, x = K.Best(np.full(16_384, 10)), rng.normal(size=(10_000, 16))
    q, most = rng.normal(size=(16_384, 16)), 0
    for low in range(0, 10_000, K.ROWS_AT_ONCE):
        rows = np.arange(low, min(10_000, low + K.ROWS_AT_ONCE))
        for a in range(0, 16_384, K.QUERIES_AT_ONCE):
            some = np.arange(a, a + K.QUERIES_AT_ONCE)
            best.offer(some, rows, K.scores_of(q[some], x[rows], "dot"), rows)
            most = max(most, best.held)
    assert most * 32 < 200e6  # four columns of eight bytes
    query, item, score, _ = best.shrink()
    for i in (0, 777, 16_383):
        wanted = np.argsort(-(x @ q[i]), kind="stable")[:10]
        assert item[query == i].tolist() == wanted.tolist()


def test_equal_scores_keep_the_least_ids():
    best = K.Best(np.array([3]))
    for low in (0, 500):
        best.offer(np.array([0]), np.arange(low, low + 500)[::-1], np.ones((1, 500)), np.arange(low, low + 500))
    assert best.shrink()[1].tolist() == [0, 1, 2]


def test_hits_bring_columns_along(spark, monkeypatch):
    lib, odd, queries = clustered(spark, 500)
    lib = lib.unionByName(odd).withColumns({"vec2": F.col("vec"), "kind": F.lit("clash"), "score": F.col("item_id").cast("string")}).repartition(6)
    monkeypatch.setattr(K, "MOST_QUERIES", 3)
    for r in K.knn(queries, lib, 4, "euclid", ["vec2", "kind", "score", "vec"]).collect():
        assert r.score == str(r.item_id) and r.kind == "clash" and r.vec2 == r.vec and len(r.vec) == (2 if r.item_id == 9004 else 24)


def line(spark, n=20):
    return spark.createDataFrame([(i, str(i), [float(i), 0.0]) for i in range(n)], "item_id long, external_id string, vec array<double>")


ONE = lambda rows: rows.select("item_id", F.lit(True).alias("valid"), (20.0 - F.abs(F.col("item_id") - 12)).alias("score"))


def test_every_embedding_of_an_input_is_a_query(spark):
    seeds = spark.createDataFrame([(1, [0.1, 0.0]), (1, [18.9, 0.0])], "input_id long, vec array<double>")
    run = S.run(S.Job(line(spark), ONE, k=3, metric="euclid", max_iterations=3, rates=[1.0]), seeds)
    rows = run.results.toPandas()
    first = rows[rows.iteration == 0]
    assert {q: set(g.item_id) for q, g in first.groupby("query_no")} == {0: {0, 1, 2}, 1: {17, 18, 19}} and len(first) == 6
    later = rows[rows.iteration > 0].groupby("query_no").item_id.agg(["min", "max"])  # each climbs on its own
    assert later["max"][0] > 2 and later["min"][1] < 17 and later["max"][0] < later["min"][1] + 10
    assert (rows[rows.fresh].groupby("item_id").iteration.nunique() == 1).all()
    assert run.inference == rows[rows.fresh].item_id.nunique() == run.inputs.first().inference


def test_queries_are_the_product_of_the_positions_embeddings(spark):
    rows = [(1, 0, 5, [1.0]), (1, 0, 2, [2.0]), (1, 1, 0, [3.0]), (1, 1, 1, [4.0]), (1, 1, 2, [5.0]), (2, 0, 0, [6.0]), (3, 0, 0, None)]
    seeds = spark.createDataFrame(rows, "input_id long, assembly_index long, embedding_no int, vec array<double>")
    got = {}
    for r in S.query_seeds(seeds, 2).orderBy("assembly_index").collect():
        got.setdefault((r.input_id, r.query_no), []).append(r.vec[0])
    assert got == {(1, 0): [2.0, 3.0], (1, 1): [2.0, 4.0], (1, 2): [2.0, 5.0], (1, 3): [1.0, 3.0], (1, 4): [1.0, 4.0], (1, 5): [1.0, 5.0]}


class Killed(Exception):
    pass


def test_a_broken_job_goes_on(spark, monkeypatch):
    """Broken off after any step, a job gives the rows of an unbroken one, and scores no item twice."""
    seeds = spark.createDataFrame([(1, [0.1, 0.0], 3), (2, [18.9, 0.0], 2), (2, [5.0, 0.0], 2)], "input_id long, vec array<double>, max_iterations long")
    counted = spark.sparkContext.accumulator(0)

    def score(rows):
        def count(batches):
            for batch in batches:
                counted.add(batch.num_rows)
                yield batch

        return ONE(rows.select("item_id").mapInArrow(count, "item_id long"))

    job = S.Job(line(spark), score, k=3, metric="euclid", max_iterations=3, rates=[1.0], filters=lambda rows: rows.withColumn("valid", F.col("item_id") != 4))
    whole = S.run(job, seeds)
    columns = ("input_id", "query_no", "iteration", "query_group", "item_id", "valid", "score", "fresh")
    rows = lambda run: sorted((tuple(r[c] for c in columns) for r in run.results.collect()), key=repr)
    wanted, states, scored = rows(whole), sorted(map(tuple, whole.inputs.collect())), counted.value
    enter, left = journal.Journal._enter, 0

    def dying(self, name, text):
        nonlocal left
        enter(self, name, text)
        left -= 1
        if left == 0:
            raise Killed

    path, counted.value, broken = f"{Workspace(spark, 'resumed').path}/job", 0, 0
    monkeypatch.setattr(journal.Journal, "_enter", dying)
    while True:
        left = 3  # some steps a life
        try:
            run = S.run(job, seeds, at=path)
            break
        except Killed:
            broken += 1
    assert broken > 4 and rows(run) == wanted and sorted(map(tuple, run.inputs.collect())) == states
    assert counted.value == scored == run.inference
    with pytest.raises(ValueError, match="other settings"):
        S.run(S.Job(line(spark), score, k=4), seeds, at=path)


def test_a_chain_stops_at_its_budget_or_its_last_seed(spark):
    pool = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate((0, 19, 5, 15, 3, 8, 1, 17))], "seed_no long, vec array<double>")
    job = S.Job(line(spark), ONE, k=3, metric="euclid", max_iterations=1)
    whole = S.chain(job, pool, 3, 0.6, 10_000)
    rows = whole.results.toPandas()
    assert whole.runs == 4 and rows.run.nunique() == 4  # 3 seeds, then 2 a run: 3, 2, 2, 1
    seeds = rows[rows.origin == "fresh"].groupby("run").seed.unique()
    assert sorted(s for run in seeds for s in run) == [str(i) for i in range(8)]  # each once
    assert rows[rows.origin == "best"].groupby("run").seed.nunique().to_dict() == {1: 1, 2: 1, 3: 1}
    for run in (1, 2, 3):  # from the job before
        before = rows[rows.run == run - 1].sort_values(["score", "item_id"], ascending=[False, True])
        assert rows[(rows.run == run) & (rows.origin == "best")].seed.iloc[0] == str(before.item_id.iloc[0])
    assert rows[rows.fresh].groupby("item_id").run.nunique().max() == 1  # known to later jobs
    assert whole.inference == rows[rows.fresh].item_id.nunique()
    every = rows.drop_duplicates("item_id").sort_values(["score", "item_id"], ascending=[False, True])
    assert [r.item_id for r in whole.best.collect()] == every.item_id.tolist()
    short = S.chain(job, pool, 3, 0.6, 10)
    assert short.runs == 2 and 10 <= short.inference < whole.inference
    assert S.chain(job, pool.limit(0), 3, 0.6, 10).runs == 0 == S.chain(job, pool, 3, 0.6, 0).results.count()
    with pytest.raises(ValueError):
        S.chain(job, pool, 0, 0.5, 10)


def test_a_broken_chain_goes_on(spark, monkeypatch):
    pool = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate((0, 19, 5))], "seed_no long, vec array<double>")
    job = S.Job(line(spark), ONE, k=3, metric="euclid", max_iterations=1)
    wanted = S.chain(job, pool, 2, 0.5, 100)
    enter, left = journal.Journal._enter, 9

    def dying(self, name, text):
        nonlocal left
        enter(self, name, text)
        left -= 1
        if left == 0:
            raise Killed

    monkeypatch.setattr(journal.Journal, "_enter", dying)
    path = f"{Workspace(spark, 'chained').path}/chain"
    with pytest.raises(Killed):
        S.chain(job, pool, 2, 0.5, 100, at=path)
    again = S.chain(job, pool, 2, 0.5, 100, at=path)
    rows = lambda c: sorted((r.run, r.seed, r.item_id, r.score, r.fresh) for r in c.results.collect())
    assert rows(again) == rows(wanted) and again.inference == wanted.inference


def test_best_products_are_the_first_of_the_whole_product(spark):
    """Ties, short and empty pools and null scores included; candidates are counted."""
    rng = np.random.default_rng(9)
    pools, sizes = [], (30, 25, 40)
    for i, n in enumerate(sizes):
        rows = [(k, 100 * i + j, float(rng.integers(0, 12)) / 4) for k in (1, 2) for j in range(n if k == 1 else (3, 0, 5)[i])] + [(3, 100 * i, 1.0), (1, 100 * i + 99, None)]
        pools.append(spark.createDataFrame(rows, "input_id long, item_id long, score double"))
    held = [sorted((r for r in p.collect() if r.score is not None), key=lambda r: (-r.score, r.item_id)) for p in pools]
    for m in (1, 7, 60, 100_000):
        got = {}
        for r in R.best_products(pools, ["input_id"], m).orderBy("place").collect():
            got.setdefault(r.input_id, []).append((r.item_id_0, r.item_id_1, r.item_id_2, r.total))
        wanted = {}
        for k in (1, 3):
            own = [[(n, r) for n, r in enumerate([r for r in h if r.input_id == k])] for h in held]
            two = sorted((-(a.score + b.score), i, j, a, b) for i, a in own[0] for j, b in own[1])
            three = sorted((t - c.score, n, l, (a.item_id, b.item_id, c.item_id, c.score - t)) for n, (t, _, _, a, b) in enumerate(two) for l, c in own[2])
            wanted[k] = [x[-1] for x in three[:m]]
        assert got == wanted
    assert R.frontier_size(list(sizes), 7) < 40 < 30 * 25 * 40 and R.frontier_size([2, 2], 100) == 4
    with pytest.raises(ValueError):
        R.best_products(pools, ["input_id"], 0)


def test_a_job_of_the_best_products(spark):
    lib = line(spark).withColumns({"embedding_id": F.col("item_id") % 2, "item": F.col("external_id")})
    seeds = spark.createDataFrame([(1, p, [8.2, 0.0]) for p in (0, 1)], "input_id long, assembly_index int, vec array<double>")
    score = lambda rows: rows.select("item_id", F.lit(True).alias("valid"), F.length("item").cast("double").alias("score"))
    job = S.Job(lib, score, k=6, metric="euclid", max_iterations=1, positions=2, assemble=lambda parts: F.concat_ws(".", *parts), products=3)
    assert sorted(r.item for r in S.run_job(job, seeds).collect()) == ["8.11", "8.7", "8.9"]


def test_ten_thousand_rules_of_many_lengths(spark, monkeypatch):
    rng = np.random.default_rng(10)
    word = lambda n: "".join(rng.choice(list("abé"), n))
    firsts, parts = [word(rng.integers(0, 14)) for _ in range(40)] + [None], [word(rng.integers(0, 14)) for _ in range(40)] + [None]
    rules = [(int(rng.integers(0, 2)), word(rng.integers(0, 9)) if i % 500 else None, word(rng.integers(1, 9)), "-" if i % 2 else None) for i in range(10_000)]
    rules += [(1, "", "a", "+")]
    frames = (spark.createDataFrame([(f,) for f in firsts], "product string"), spark.createDataFrame([(s, p) for p in parts for s in (0, 1)], "stage int, part string"), spark.createDataFrame(rules, "stage int, left string, right string, sep string"))
    current = {f for f in firsts if f is not None}
    for s in range(2):
        own = {(a, b, c or "") for t, a, b, c in rules if t == s and a is not None}
        current = {f + c + p for f in current for p in parts if p is not None for a, b, c in own if f.endswith(a) and p.startswith(b)}
        if s == 0:
            current = set(sorted(current)[:60])
            frames = (spark.createDataFrame([(f,) for f in current], "product string"), frames[1].filter("stage = 1").withColumn("stage", F.lit(0)), frames[2].filter("stage = 1").withColumn("stage", F.lit(0)))
    assert current
    for most in (100_000, 50):  # by tries, and by lengths
        monkeypatch.setattr(S, "MOST_RULES", most)
        assert {r.product for r in S.staged_assembly(*frames, 1).collect()} == current
    assert S.staged_assembly(*frames, 2).count() == 0  # no rules in the second stage


def test_vectors_of_slices():
    column = pa.array([[1.0, 2.0], None, [3.0, None], [], [4.0]], pa.list_(pa.float64()))
    values, starts, sizes = K.vectors_of(column.slice(1))
    assert sizes.tolist() == [-1, -1, 0, 1] and values[starts[3]] == 4.0


def test_components_are_dealt_before_they_are_grouped(spark, sf):
    from vecclimb.queries.standins import components

    rows = components(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Aggregate" in plan and "Aggregate" not in plan.rsplit("Exchange", 1)[1]
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey"))
    assert rows.rdd.getNumPartitions() == 4 and sorted(map(tuple, rows.collect())) == sorted(map(tuple, lines.collect()))

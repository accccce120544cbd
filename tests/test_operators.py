"""Operators against numpy and fixed small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecclimb import catalog
from vecclimb.functions import scalars as J
from vecclimb.functions import vectors as V
from vecclimb.operators import filters as B
from vecclimb.operators import knn as K
from vecclimb.operators import relations as R
from vecclimb.operators import roles
from vecclimb.operators import upserts as I
from vecclimb.operators import windows as W
from vecclimb.operators.sums import mean_vectors, tops_and_gradients
from vecclimb.plans import search as S
from vecclimb.session import Workspace, table
from vecclimb.sources import library as A
from vecclimb.streaming import jobs as M


def library(spark, n=300, size=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x[7] = x[5]  # a tie
    return x, spark.createDataFrame([(i, f"item{i}", str(i), v.tolist()) for i, v in enumerate(x)], "item_id long, item string, external_id string, vec array<double>")


def similarity(metric, q, x):
    if metric == "cosine":
        return x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return x @ q if metric == "dot" else 1 / (1 + np.linalg.norm(x - q, axis=1))


@pytest.mark.parametrize("metric", K.METRICS)
def test_knn(spark, metric, monkeypatch):
    x, lib = library(spark)
    queries = lib.filter("item_id < 12").select(F.col("item_id").alias("query_id"), "vec")
    for most in (16_384, 5):  # one pass, and several
        monkeypatch.setattr(K, "MOST_QUERIES", most)
        got = {(r.query_id, r["rank"]): r.item_id for r in K.knn(queries, lib, 6, metric).collect()}
        for q in range(12):
            s = similarity(metric, x[q], x)
            assert [got[q, k + 1] for k in range(6)] == sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:6]
        assert len(got) == 72


def test_knn_odd_rows(spark):
    lib = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0, 0.0])], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, vec array<double>")
    assert [tuple(r)[:2] for r in K.knn(queries, lib, 5).collect()] == [(1, 4)]
    assert K.knn(queries, lib.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        K.knn(queries, lib, 5, "other")


@pytest.mark.parametrize("metric", ["euclid", "cosine", "dot"])
def test_gradient_is_that_of_the_loss(spark, metric):
    rng = np.random.default_rng(2)
    e, q, a = rng.normal(size=(9, 5)), rng.normal(size=5), rng.normal(size=9)

    def loss(p):
        if metric == "euclid":
            return (a * ((p - e) ** 2).mean(axis=1)).mean()
        dot = e @ p
        return (a * dot).mean() if metric == "dot" else (a * (1 - dot / (np.linalg.norm(e, axis=1) * np.linalg.norm(p)))).mean()

    rows = spark.createDataFrame([(1, v.tolist(), float(w)) for v, w in zip(e, a)], "input_id long, vec array<double>, advantage double")
    top = spark.createDataFrame([(1, q.tolist())], "input_id long, vec array<double>")
    got = np.array(S.gradients(rows, top, ["input_id"], metric).first().gradient)
    h = 1e-6
    assert np.allclose(got, [(loss(q + h * d) - loss(q - h * d)) / (2 * h) for d in np.eye(5)], atol=1e-6)
    if metric == "dot":
        assert np.allclose(-got, S.gradients(rows, top, ["input_id"], metric, dot_as_distance=True).first().gradient)


def test_single_result_has_no_gradient(spark):
    rows = spark.createDataFrame([(1, 5, 0, [1.0, 2.0], 3.0, 1, True)], "input_id long, item_id long, query_group int, vec array<double>, score double, seq int, valid boolean")
    assert S.update(rows, ["input_id"], "cosine").first().gradient == [0.0, 0.0]


def test_steps(spark):
    state = spark.createDataFrame([(1, [1.0, 1.0], [0.5, 0.0], [1.0, 2.0]), (2, [3.0, 3.0], None, [1.0])], "input_id long, vec array<double>, gradient array<double>, rates array<double>")
    got = {(r.input_id, r.query_group): r.vec for r in S.step_embeddings(state, ["input_id"]).collect()}
    assert got == {(1, 0): [1.0, 1.0], (1, 1): [0.5, 1.0], (1, 2): [0.0, 1.0], (2, 0): [3.0, 3.0]}


@pytest.mark.parametrize("metric", ["euclid", "cosine", "dot"])
def test_gradients_in_one_pass_are_those_of_advantages(spark, metric, monkeypatch):
    monkeypatch.setattr("vecclimb.operators.sums.MOST_KEYS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(k), i, (rng.normal(size=4) + 1).tolist(), float(round(rng.normal() * 3 + 100)), i) for i, k in enumerate(rng.integers(0, 9, 300))]
    rows += [(20, 1000, [1.0, 2.0], 5.0, 1), (21, 1001, None, 7.0, 1), (21, 1002, [1.0, 1.0], 6.0, 1)]
    frame = spark.createDataFrame(rows, "k long, item_id long, vec array<double>, score double, seq long").repartition(5)
    got = {r.k: r for r in tops_and_gradients(frame, ["k"], metric).collect()}
    plain = frame.filter("k < 20")
    tops = W.top_result(plain, ["k"])
    for r in S.gradients(R.advantages(plain, ["k"]), tops, ["k"], metric).collect():
        assert np.allclose(got[r.k].gradient, r.gradient, atol=1e-9)
    assert {r.k: r.vec for r in tops.collect()} == {k: r.vec for k, r in got.items() if k < 20}
    assert got[20].gradient == [0.0, 0.0] and got[21].vec is None and not got[21].gradient


def test_means_skip_what_is_no_number(spark):
    """Nulls and NaN count at no position; short and long vectors of a key meet by position."""
    nan = float("nan")
    rows = [(1, [1.0, None]), (1, [3.0, 4.0]), (1, None), (1, []), (2, [nan, 2.0]), (2, [5.0]), (3, [None, nan]), (None, [1.0, 2.0, 3.0]), (None, [3.0])]
    frame = spark.createDataFrame(rows, "k long, vec array<double>").repartition(3)
    assert {r.k: r.vec for r in mean_vectors(frame, ["k"]).collect()} == {1: [2.0, 4.0], 2: [5.0, 2.0], 3: [0.0, 0.0], None: [2.0, 2.0, 3.0]}


def test_means_of_more_keys_than_are_held(spark, monkeypatch):
    monkeypatch.setattr("vecclimb.operators.sums.MOST_KEYS", 5)
    frame = spark.range(0, 3000, 1, 6).selectExpr("id % 100 as k", "array(double(id), double(id % 7)) as vec")
    got = {r.k: r.vec for r in mean_vectors(frame, ["k"]).collect()}
    ids = np.arange(3000)
    assert len(got) == 100 and all(np.allclose(v, [ids[ids % 100 == k].mean(), (ids[ids % 100 == k] % 7).mean()]) for k, v in got.items())


def test_job_climbs_and_scores_once(spark):
    x, lib = library(spark, 400, 4, 3)
    goal = np.array([1.0, 1.0, 1.0, 1.0])
    value = {i: float(v @ goal) for i, v in enumerate(x)}
    scores = spark.createDataFrame(list(value.items()), "item_id long, score double")
    score = lambda rows: rows.join(scores, "item_id").withColumn("valid", F.lit(True))
    worst = sorted(value, key=value.get)[:2]
    seeds = lib.filter(F.col("item_id").isin(worst)).select(F.col("item_id").alias("input_id"), "vec")
    rows = S.run_job(S.Job(lib, score, k=8, metric="euclid", rates=[2.0, 8.0], max_iterations=5), seeds).toPandas()
    best = rows.groupby(["input_id", "iteration"]).score.max().unstack()
    assert (best[4] > best[0] + 1).all()
    fresh = rows[rows.fresh].groupby("item_id").iteration.nunique()
    assert (fresh == 1).all()
    limited = S.run_job(S.Job(lib, score, k=8, max_iterations=5, inference_limit=3), seeds)
    assert limited.agg(F.max("iteration")).first()[0] == 0


def test_jobs_over_products(spark):
    """Assembled and mapped jobs climb, filter before they score, and stop by input limits with a status."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    lib = spark.createDataFrame([(i, str(i), str(i), i % 2, v.tolist()) for i, v in enumerate(x)], "item_id long, item string, external_id string, embedding_id int, vec array<double>")
    goal = np.array([1.0, -1.0, 1.0, 0.5])
    value = {str(i): float(v @ goal) for i, v in enumerate(x)}
    worth = F.udf(lambda item: sum(value[p] for p in item.split(".")), "double")
    score = lambda rows: rows.withColumns({"score": worth("item"), "valid": F.lit(True)})
    filters = lambda rows: rows.withColumn("valid", F.col("valid") & ~F.col("item").startswith("4."))
    join = lambda parts: F.concat_ws(".", *parts)
    low = sorted(range(60), key=lambda i: value[str(i)])
    a, b = [i for i in low if i % 2 == 0][:2], [i for i in low if i % 2 == 1][:2]
    rows = [(k, p, x[i].tolist(), limit) for k, limit in ((0, None), (1, 5)) for p, i in ((0, a[k]), (1, b[k]))]
    seeds = spark.createDataFrame(rows, "input_id long, assembly_index int, vec array<double>, inference_limit long")
    done = S.run(S.Job(lib, score, k=4, metric="euclid", rates=[2.0, 8.0], max_iterations=4, positions=2, assemble=join, filters=filters), seeds)
    got = done.results.toPandas()
    best = got[got.input_id == 0].groupby("iteration").score.max()
    assert best[3] > best[0] + 0.5 and not got[got.item.str.startswith("4.")].valid.any()
    states = {r.input_id: (r.iterations, r.status) for r in done.inputs.collect()}
    assert states[0] == (4, "complete") and states[1] == (1, "early_stop") and got[got.input_id == 1].iteration.max() == 0
    fresh = got[got.fresh].drop_duplicates(["item_id"])
    assert sum(r.inference for r in done.inputs.collect()) == len(fresh) == sum(r.executed for r in done.log.collect())
    assert (fresh.groupby("item_id").iteration.nunique() == 1).all()

    mapper = lambda rows: roles.mapped(rows, F.array(F.col("vec"), V.scale(F.col("vec"), F.lit(1.0))))
    middle = lambda v: F.zip_with(*v, lambda p, q: (p + q) / 2)
    single = seeds.filter("assembly_index = 0").select("input_id", "vec")
    climbed = S.run(S.Job(lib, score, k=4, metric="euclid", rates=[2.0, 8.0], max_iterations=4, positions=2, assemble=join, mapper=mapper, embed=middle), single)
    best = climbed.results.groupBy("input_id", "iteration").agg(F.max("score").alias("s")).toPandas().pivot(index="input_id", columns="iteration", values="s")
    assert (best[3] > best[0] + 0.5).all()
    assert {r.status for r in climbed.inputs.collect()} == {"complete"}


def test_stop_rules(spark):
    rows = [(1, 0, 3, True, 5, None, 0, None), (2, 2, 3, True, 5, None, 0, None), (3, 0, 3, False, 5, None, 0, None), (4, 0, 3, True, 6, 5, 0, None), (5, 0, 3, True, 5, 5, 0, None), (6, 0, 3, True, 0, None, 11, 10), (7, 2, 3, True, 9, 5, 0, None)]
    state = spark.createDataFrame(rows, "i int, iteration int, max_iterations int, has_queries boolean, inference long, inference_limit long, age int, time_limit int")
    now = F.timestamp_seconds(F.lit(1000))
    state = state.select("*", F.timestamp_seconds(1000 - F.col("age")).alias("started_at"), F.lit(0).alias("parent_inference"), F.lit(None).cast("long").alias("parent_inference_limit"), now.alias("parent_started_at"), F.lit(None).cast("int").alias("parent_time_limit"))
    got = {r.i: (r.stop, r.status) for r in S.should_stop(state, now).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True}
    assert got[2][1] == "complete" and got[7][1] == got[3][1] == "early_stop"


def test_status_rollup(spark):
    rows = [(1, "complete"), (1, "failed"), (1, "running"), (2, "complete"), (2, "failed"), (3, "complete"), (3, "early_stop"), (4, "complete"), (5, None)]
    got = dict(map(tuple, R.status_rollup(spark.createDataFrame(rows, "parent_id long, status string")).collect()))
    assert got == {1: None, 2: "complete_with_errors", 3: "early_stop", 4: "complete", 5: None}


def test_checkins_and_upserts(spark):
    items = spark.createDataFrame([(9, "a")], "item_id long, item string")
    merged, out = I.checkin_items(items, spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("b", 4)], "item string, seq int"))
    ids = {r.seq: r.item_id for r in out.collect()}
    assert ids[1] == ids[3] == 9 and ids[2] == ids[4] != 9 and merged.count() == 2
    results = spark.createDataFrame([(1, 9.42)], "item_id long, score double")
    new = I.merge_last(results, spark.createDataFrame([(1, 5.0, 1), (1, 3.42, 2), (2, 1.0, 1)], "item_id long, score double, seq int"), ["item_id"])
    assert dict(map(tuple, new.collect())) == {1: 3.42, 2: 1.0}
    counts = spark.createDataFrame([(1, 1, 3)], "result_id long, iteration_id long, count long")
    assert I.accumulate_counts(counts, spark.createDataFrame([(1, 1, 2), (1, 1, 0)], counts.schema)).first()["count"] == 5
    none = spark.createDataFrame([], "assembly_id long, assembly_key string, component_key string, product_id long")
    batch = spark.createDataFrame([(7, [(0, 1), (1, 2)]), (7, [(1, 2), (0, 1)]), (7, [(0, 2), (1, 1)])], "product_id long, components array<struct<assembly_index:int,item_id:long>>")
    assemblies, parts = I.checkin_assemblies(none, batch, 3)
    assert {r.assembly_key for r in assemblies.collect()} == {"3_1_2_7", "3_2_1_7"} and parts.count() == 4
    again, more = I.checkin_assemblies(assemblies, batch, 3)
    assert again.count() == 2 and more.count() == 0


def test_null_assembly_is_a_key(spark):
    old = spark.createDataFrame([(1, 1, 1, None, True), (2, 1, 1, 5, True)], "result_id long, job_id long, item_id long, assembly_id long, valid boolean")
    new = spark.createDataFrame([(1, 1, None, True, 1), (1, 1, None, False, 2), (1, 2, None, True, 1)], "job_id long, item_id long, assembly_id long, valid boolean, seq int")
    got = {(r.item_id, r.assembly_id): (r.valid, r.result_id in (1, 2)) for r in I.upsert_results(old, new).collect()}
    assert got == {(1, None): (False, True), (1, 5): (True, True), (2, None): (True, False)}


def test_role_runs_once_a_key_and_failures_stay_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def half(batch):
        seen.add(len(batch))
        return batch["x"].map(lambda v: 10 // v)

    requests = spark.createDataFrame([("k0", 0), ("k1", 1), ("k1", 1), ("k2", 2), ("k3", 3)], "key string, x long")
    cache, store = spark.createDataFrame([("k2", 50)], "key string, value long"), spark.createDataFrame([("k2", 51), ("k3", 52)], "key string, value long")
    plugin = roles.Plugin(1, "score", roles.from_pandas(half, "long"))
    out = roles.execute_role(plugin, requests, "key", cache, store).collect()
    assert sorted((r.key, r.value, r.valid, r.source) for r in out if r.key != "k0") == [("k1", 10, True, "remaining")] * 2 + [("k2", 50, True, "cache"), ("k3", 52, True, "store")]
    assert [(r.value, r.valid, r.error.split(":")[0]) for r in out if r.key == "k0"] == [(None, False, "ZeroDivisionError")]
    calls = seen.value
    frame = roles.execute_role(plugin, requests, "key", cache, store)
    assert {r.key: r.value for r in roles.stored_results(plugin, frame, store, "key").collect()} == {"k1": 10, "k2": 51, "k3": 52}
    frame.collect(), roles.failures(frame, plugin, 8).collect()
    assert seen.value - calls == 4  # k0 and k1 in a batch or alone, once for all three reads
    other = roles.Plugin(1, "mapper", plugin.build)
    assert roles.stored_results(other, frame, store, "key").count() == 2 and roles.stored_results(other, frame, store, "key", keep=True).count() == 3
    fresh = roles.execute_role(plugin, requests, "key", cache, store, use_cache=False).filter("key = 'k2'").first()
    assert (fresh.value, fresh.source) == (51, "store")
    scaled = roles.Plugin(1, "score", roles.from_column(F.col("x") * F.col("by")))
    assert roles.execute_role(scaled, requests, "key", cache, store, args={"by": 7}).filter("key = 'k1'").first().value == 7
    log = R.execution_log(spark.createDataFrame(out).withColumn("plugin_id", F.lit(1))).first()
    assert (log.inputs, log.unique_inputs, log.cache_hits, log.stored_hits, log.executed, log.failed) == (5, 4, 1, 1, 2, 1)
    assert roles.failures(spark.createDataFrame(out), plugin, 8).select("job_id", "request").first() == (8, '{"key":"k0","x":0}')


def test_filters(spark):
    rows = spark.createDataFrame([(1, 5.0, "ab"), (2, None, "ab"), (3, 10.0, None)], "i int, p double, t string")
    assert {r.i: r.ok for r in rows.select("i", B.in_range(F.col("p"), 5, 9.5).alias("ok")).collect()} == {1: True, 2: False, 3: False}
    assert {r.i: r.ok for r in rows.select("i", B.combined(F.col("t"), {"p": (None, None)}, ["z"], [("a", 1, 1)]).alias("ok")).collect()} == {1: True, 2: False, 3: False}
    for weights in ([], [("p", 1.0), ("p", 2.0)]):
        with pytest.raises(ValueError):
            B.weighted_score(weights)


def test_scalars(spark):
    row = spark.createDataFrame([("[U:10]x[Np:4]y[U:10]", "a..b", [(1, 20), (0, 10)])], "m string, t string, c array<struct<assembly_index:int,item_id:int>>")
    got = row.select(J.extract_marks(F.col("m")), J.count_parts(F.col("t")), J.assembly_key(F.lit(2), F.col("c"), F.lit(5)), J.strip_key(J.request_key(F.lit(1), "item", F.lit(4)), "item"), V.reshape_flat(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), 2, 2)).first()
    assert tuple(got) == (["[U:10]", "[Np:4]"], 3, "2_10_20_5", "4", [[1.0, 2.0], [3.0, 4.0]])


def test_pages_do_not_overlap(spark):
    rows = spark.createDataFrame([(i, 0.5 if i < 8 else None) for i in range(10)], "result_id long, score double")
    order = (F.desc_nulls_last("score"), F.col("result_id"))
    pages = [[r.result_id for r in W.page(rows, *order, offset=o, limit=4).collect()] for o in (0, 4, 8)]
    assert pages == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and W.page(rows, *order).count() == 10


def test_a_failing_batch_takes_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def fragile(batch):
        calls.add(1)
        if (batch["x"] % 50 == 7).any():
            raise ValueError("seven")
        return batch["x"] * 2

    rows = spark.range(4000).withColumnRenamed("id", "x").coalesce(1)
    out = roles.from_pandas(fragile, "long", spread=True)(rows).cache()
    assert [tuple(r) for r in out.filter("x % 50 = 7").select("value", "valid", "error").distinct().collect()] == [(None, False, "ValueError: seven")]
    assert out.filter("x % 50 <> 7 and valid and value = x * 2 and error is null").count() == 3920
    assert calls.value < 1600 and out.rdd.getNumPartitions() == 4
    every = roles.from_pandas(lambda batch: batch["x"].map({3: 5}.__getitem__), "long")(rows.limit(9)).collect()
    assert [(r.x, r.value) for r in every if r.valid] == [(3, 5)] and {r.error for r in every if r.x == 8} == {"KeyError: 8"}


def test_nested_export(spark):
    inputs = spark.createDataFrame([(1,), (2,)], "input_id long")
    iterations = spark.createDataFrame([(1, 0), (1, 1)], "input_id long, iteration int")
    results = spark.createDataFrame([(1, 0, 5, 0.2), (1, 0, 6, 0.9), (1, 0, 7, None)], "input_id long, iteration int, item_id long, score double")
    got = {r.input_id: r.iterations for r in R.nested_export(inputs, iterations, results).collect()}
    assert got[2] is None and [[x.item_id for x in i.results] for i in got[1]] == [[6, 5, 7], []]


def test_retention_chain(spark):
    components = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "assembly_id long, item_id long")
    assemblies = spark.createDataFrame([(1, 2), (2, 2), (3, 0)], "assembly_id long, required long")
    results = spark.createDataFrame([(1,), (2,), (None,)], "assembly_id long")
    assert {r.assembly_id for r in R.stale_assemblies(assemblies, components, results).collect()} == {2, 3}
    items = spark.createDataFrame([(i,) for i in (10, 11, 12, 13)], "item_id long")
    assert [r.item_id for r in R.unreferenced(items, "item_id", [(components, "item_id")]).collect()] == [13]


def test_library_files(spark):
    with pytest.raises(ValueError):
        A.scan_library(spark)
    records = A.scan_library(spark, records=[("x", "1"), ("y", None)])
    embedded = A.embed_items(A.records_to_items(records), {1: F.when(F.col("item") == "x", F.array(F.lit(3.0), F.lit(4.0))), 2: F.array(F.lit(1.0))})
    path = Workspace(spark, "lib").path
    A.load_library(embedded, path, 4)
    points = spark.read.parquet(f"{path}/points")
    assert {(r.item, r.embedding_id): (r.vec, r.norm) for r in points.collect()} == {("x", 1): ([0.6, 0.8], 5.0), ("x", 2): ([1.0], 1.0), ("y", 2): ([1.0], 1.0)}
    assert [tuple(r) for r in spark.read.parquet(f"{path}/failures").collect()] == [(4, "y", None)]
    assert tuple(A.load_summary(embedded).first()) == (1, 1)
    A.snapshot(points, path, "v1")
    with pytest.raises(Exception, match="v1"):
        A.snapshot(points, path, "v1")


def test_streams(spark):
    path = Workspace(spark, "streams").path
    jobs = spark.sql("select id as job_id, if(id % 2 = 0, 'created', 'running') as status, id <> 4 as auto_run, timestamp_seconds(1700000000 + id) as created_at from range(10)")
    jobs.write.parquet(f"{path}/jobs")
    jobs.write.mode("append").parquet(f"{path}/jobs")
    pending = M.stream_pending(spark, f"{path}/jobs", "job_id long, status string, auto_run boolean, created_at timestamp")
    run = pending.writeStream.format("parquet").option("path", f"{path}/queued").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(f"{path}/queued").collect()) == [0, 2, 6, 8]
    assert sorted(r.job_id for r in M.pending(jobs, 2).collect()) == [6, 8]


def test_partners_are_counted_over_all_fragments(spark, sf):
    fragments = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d", "c"]), (3, ["a", "c"]), (4, ["c", "a"]), (5, []), (6, None), (7, ["d"])], "id long, marks array<string>")
    rules = spark.createDataFrame([("a", "c"), ("b", "d"), ("b", "c")], "left_mark string, right_mark string")
    pairs = {(r.left_id, r.right_id) for r in R.marked_pairs(fragments, rules).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (1, 7), (3, 2), (3, 4), (4, 2), (4, 3)}
    assert {r.id: r.partners for r in R.marked_partner_counts(fragments, rules).collect()} == {1: 4, 2: 0, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0}
    assert catalog.queries()["mark_compatibility_counts"](spark, sf).count() == table(spark, sf, "part").count()


def test_pairs_of_a_frequent_mark_are_not_shuffled(spark):
    marks = F.when(F.col("id") < 2500, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("d"), F.lit(None)))
    fragments = spark.range(5000).select("id", marks.alias("marks"))
    twice = fragments.unionByName(spark.createDataFrame([(1, ["c"]), (None, ["a"])], "id long, marks array<string>"))  # 1 stands on both sides
    rules = spark.createDataFrame([("a", "c"), ("b", "d"), ("b", "d")], "left_mark string, right_mark string")
    pairs = R.marked_pairs(twice, rules)
    last = pairs._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert "Generate" in last and "Aggregate" not in last and "Join" not in last
    assert pairs.count() == pairs.distinct().count() == 2500 * 2501 - 1
    assert pairs.rdd.getNumPartitions() == 4


def test_blocks_of_a_frequent_mark_are_dealt_whole_and_taken_apart_in_parts(spark):
    marks = F.when(F.col("id") < 2500, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b")))
    pairs = R.marked_pairs(spark.range(5000).select("id", marks.alias("marks")), spark.createDataFrame([("a", "b")], "left_mark string, right_mark string"))
    run = pairs._jdf.queryExecution()
    assert run.toRdd().count() == 2500 * 2500
    nodes = []

    def walk(node):
        nodes.append(node)
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(run.executedPlan())
    names = [n.nodeName() for n in nodes]
    counted = lambda n, metric: n.metrics().apply(metric).value()
    assert counted(nodes[names.index("Exchange")], "shuffleRecordsWritten") <= 4  # the last shuffle comes first
    rows = counted(next(n for n in nodes[names.index("Coalesce"):] if n.nodeName() == "Generate"), "numOutputRows")
    assert 2500 * 2500 / R.PART**2 <= rows <= 2 * 2500 * 2500 / R.PART**2

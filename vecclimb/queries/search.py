"""Vector search, vector functions, gradients and the search loop (C, F1, J4-J6, J15, E10-E13, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecclimb.catalog import register
from vecclimb.functions import vectors as V
from vecclimb.operators import knn as K
from vecclimb.operators import relations as R
from vecclimb.operators import roles
from vecclimb.operators.index import VectorIndex
from vecclimb.plans import search as S
from vecclimb.queries.standins import LIB, RES, Q, asked, item_results, items, library
from vecclimb.session import Workspace


def rounded() -> tuple:
    return F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")




def plain(spark: SparkSession, d: str) -> DataFrame:
    """The query set, over all vectors of the library."""
    return asked(spark, d).drop("embedding_id")


COS = "list_cosine_similarity(q.vec, lib.vec)"


def knn_sql(score: str, order: str, similarity: str, distance: str, where: str = "true", k: str = "10", name: str = "f") -> str:
    return f"{name} as (select * from (select q.query_id, lib.item_id, round({similarity}, 6) as similarity, round({distance}, 6) as distance, row_number() over (partition by q.query_id order by {score} {order}, lib.item_id) as rank from q, lib where {where}) where rank <= {k})"


COSINE = f"with {Q}, " + knn_sql(COS, "desc", COS, f"1 - {COS}")


@register("search_scored_neighbours", f"{COSINE}, {RES} select f.query_id, f.item_id, f.similarity, f.rank, d.lang, length(d.text) as chars, res.score, res.valid from f join documents d on d.doc_id = f.item_id left join res on res.item_id = f.item_id")
def search_scored_neighbours(spark: SparkSession, d: str) -> DataFrame:
    hits = K.knn(plain(spark, d), library(spark, d))
    texts = items(spark, d).select("item_id", "lang", F.length("item").cast("long").alias("chars"))
    out = R.with_scores(hits.join(texts, "item_id"), item_results(spark, d), ["item_id"])
    return out.select("query_id", "item_id", rounded()[0], rounded()[2], "lang", "chars", "score", "valid")


@register("knn_cosine", f"{COSINE} select * from f")
def knn_cosine(spark, d):
    return K.knn(plain(spark, d), library(spark, d)).select("query_id", "item_id", *rounded())


L2 = "list_distance(q.vec, lib.vec)"


@register("knn_euclid", f"with {Q}, {knn_sql(L2, 'asc', f'1 / (1 + {L2})', L2, 'q.query_id <> lib.item_id')} select * from f")
def knn_euclid(spark, d):
    hits = K.knn(plain(spark, d), library(spark, d), 11, "euclid").filter("query_id <> item_id")
    return K.top_k(hits.drop("rank"), ["query_id"], [F.desc("similarity"), F.col("item_id")], 10).select("query_id", "item_id", *rounded())


IP = "list_inner_product(q.vec, lib.vec)"


@register("knn_dot", f"with {Q}, {knn_sql(IP, 'desc', IP, IP)} select * from f")
def knn_dot(spark, d):
    return K.knn(plain(spark, d), library(spark, d), 10, "dot").select("query_id", "item_id", *rounded())


@register("knn_batch", f"{COSINE} select query_id, cast(count(*) as bigint) as n_hits, string_agg(cast(item_id as varchar), ',' order by rank) as hits from f group by query_id")
def knn_batch(spark, d):
    hits = K.knn(plain(spark, d), library(spark, d))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("h")).select("query_id", "n_hits", F.array_join(F.transform("h", lambda h: h["item_id"].cast("string")), ",").alias("hits"))


@register("knn_named_vector", f"with {Q}, {knn_sql(COS, 'desc', COS, f'1 - {COS}', 'q.embedding_id = lib.embedding_id')} select * from f")
def knn_named_vector(spark, d):
    return K.knn(asked(spark, d), library(spark, d)).select("query_id", "item_id", *rounded())


@register("knn_missing_vector", f"with {Q} select q.query_id, count(lib.item_id) > 0 as valid, cast(least(count(lib.item_id), 10) as bigint) as n_hits from q left join lib on lib.label = q.query_id // 100 % 14 group by 1")
def knn_missing_vector(spark, d):
    queries = asked(spark, d).withColumn("embedding_id", F.expr("query_id div 100 % 14"))
    lib = library(spark, d).withColumn("embedding_id", F.col("label"))
    return K.knn_responses(queries, K.knn(queries, lib))


@register("knn_routed", f"with {Q}, {knn_sql(COS, 'desc', COS, f'1 - {COS}', 'q.embedding_id = lib.embedding_id', 'case when query_id in (select query_id from q where embedding_id = 0) then 3 else 7 end')} select * from f")
def knn_routed(spark, d):
    config = spark.createDataFrame([(0, 3), (1, 7)], "embedding_id long, k int")
    return K.knn(asked(spark, d).join(F.broadcast(config), "embedding_id"), library(spark, d)).select("query_id", "item_id", *rounded())


_INDEXES: dict[tuple[str, str, str], VectorIndex] = {}


def index(spark: SparkSession, d: str, metric: str) -> VectorIndex:
    """The library's index, built once an application: of the even items, and the odd ones appended."""
    key = (spark.sparkContext.applicationId, d, metric)
    if key not in _INDEXES:
        built = VectorIndex.build(library(spark, d).filter("item_id % 2 = 0"), f"{Workspace(spark, 'index').path}/library", metric, cells=16, carry=["external_id"])
        if built.model is not None:
            built.append(library(spark, d).filter("item_id % 2 = 1"), ["external_id"])
        _INDEXES[key] = built
    return _INDEXES[key]


@register("knn_approx")
def knn_approx(spark, d):
    """By codes of 14 of 16 cells, then by the vectors of at most 100 rows a query."""
    return index(spark, d, "cosine").search(plain_kinds(asked(spark, d)), probes=14).hits.select("query_id", "item_id", *rounded())


def plain_kinds(queries: DataFrame) -> DataFrame:
    """Each query for its own named vector."""
    return queries.select("query_id", "embedding_id", "vec")


@register("index_rows", f"with {LIB} select embedding_id, count(*) as n, cast(sum(item_id) as bigint) as ids, round(sum(sqrt(list_inner_product(vec, vec))), 4) as norms from lib group by 1")
def index_rows(spark, d):
    """What the index holds, by named vector: every row of the library once."""
    rows = index(spark, d, "cosine").rows()
    return rows.groupBy(F.col("kind").alias("embedding_id")).agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"), F.round(F.sum(V.norm(F.col("vec"))), 4).alias("norms"))


for _metric, _sql in (("cosine", ("desc", COS, f"1 - {COS}")), ("euclid", ("asc", f"1 / (1 + {L2})", L2)), ("dot", ("desc", IP, IP))):

    def _pruned(spark, d, metric=_metric):
        found = index(spark, d, metric).exact(plain_kinds(asked(spark, d)), carry=["external_id"]).hits
        return found.select("query_id", "item_id", "external_id", *rounded())

    _score = {"cosine": COS, "euclid": L2, "dot": IP}[_metric]
    register(f"knn_pruned_{_metric}", f"with {Q}, {knn_sql(_score, *_sql, 'q.embedding_id = lib.embedding_id')} select query_id, item_id, cast(item_id as varchar) as external_id, similarity, distance, rank from f")(_pruned)


@register("rescale_by_norm", f"with {LIB} select item_id, round(sqrt(list_inner_product(list_transform(vec, lambda x: x * (1 + label)), list_transform(vec, lambda x: x * (1 + label)))), 6) as norm from lib")
def rescale_by_norm(spark, d):
    stored = F.when(F.col("label") > 0, 1 + F.col("label"))
    return library(spark, d).select("item_id", F.round(V.norm(V.rescale_by_norm(F.col("vec"), stored)), 6).alias("norm"))


@register("knn_to_items", f"{COSINE} select f.query_id, q.embedding_id as query_group, f.item_id, lib.external_id, f.rank, round(lib.vec[1], 6) as first from f join lib using (item_id) join q using (query_id)")
def knn_to_items(spark, d):
    queries, lib = asked(spark, d).withColumnRenamed("embedding_id", "query_group"), library(spark, d)
    return K.knn_to_items(queries, lib).select("query_id", "query_group", "item_id", "external_id", F.col("rank").cast("long").alias("rank"), F.round(F.element_at("vec", 1), 6).alias("first"))


@register("topk_per_query", "select * from (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 5")
def topk_per_query(spark, d):
    rows = items(spark, d).select(F.col("item_id").alias("doc_id"), "source", "n_chars")
    return K.top_k(rows, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).withColumn("rank", F.col("rank").cast("long"))


@register("vector_ops", f"with {Q} select q.query_id, lib.item_id, round({IP}, 6) as dot, round({L2}, 6) as euclid, round({COS}, 6) as cosine, round(2 * lib.vec[1], 6) as scaled from q join lib on lib.label = q.query_id // 100 % 10")
def vector_ops(spark, d):
    q = asked(spark, d).select("query_id", F.col("vec").alias("q"), F.expr("query_id div 100 % 10").alias("label"))
    rows = library(spark, d).join(F.broadcast(q), "label")  # the stated query set
    a, b = F.col("q"), F.col("vec")
    return rows.select("query_id", "item_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.euclid(a, b), 6).alias("euclid"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(F.element_at(V.scale(b, F.lit(2.0)), 1), 6).alias("scaled"))


@register("nan_guard", "select vec_id, label not in (3, 5) as ok, label not in (3, 5) as ok_nested from embeddings")
def nan_guard(spark, d):
    spoiled = F.when(F.col("label").isin(3, 5), F.concat(F.col("vec"), F.array(F.lit(float("nan"))))).otherwise(F.col("vec"))
    return library(spark, d).select(F.col("item_id").alias("vec_id"), (~V.has_nan(spoiled)).alias("ok"), (~V.has_nan_nested(F.array(F.col("vec"), spoiled))).alias("ok_nested"))


@register("reshape_flat", f"with {LIB} select item_id, cast(g.i as bigint) as part, round(list_sum(vec[g.i * 16 + 1 : g.i * 16 + 16]), 6) as total from lib, (select unnest([0, 1, 2, 3]) as i) g")
def reshape_flat(spark, d):
    parts = library(spark, d).select("item_id", F.posexplode(V.reshape_flat(F.col("vec"), 4, 16)).alias("part", "v"))
    return parts.select("item_id", F.col("part").cast("long").alias("part"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("normalise_vector", f"with {LIB} select item_id, round(vec[1] / sqrt(list_inner_product(vec, vec)), 6) as first, cast(1.0 as double) as norm from lib")
def normalise_vector(spark, d):
    unit = V.normalise(V.scale(F.col("vec"), F.lit(3.0)))
    return library(spark, d).select("item_id", F.round(F.element_at(unit, 1), 6).alias("first"), F.round(V.norm(unit), 6).alias("norm"))


@register("step_embeddings", f"with {LIB} select item_id, cast(g.n as bigint) as query_group, round(vec[1] - g.rate * vec[2], 6) as first, round(vec[64] - g.rate * vec[1], 6) as last from lib, (select unnest([0, 1, 2]) as n, unnest([0.0, 0.5, 2.0]) as rate) g")
def step_embeddings(spark, d):
    turned = F.concat(F.slice("vec", 2, 63), F.slice("vec", 1, 1))
    state = library(spark, d).select("item_id", "vec", turned.alias("gradient"), F.array(F.lit(0.5), F.lit(2.0)).alias("rates"))
    return S.step_embeddings(state, ["item_id"]).select("item_id", F.col("query_group").cast("long").alias("query_group"), F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", 64), 6).alias("last"))


def scored(spark, d):
    """Library vectors with item results: label is the input, n_chars % 3 the query group."""
    return library(spark, d).join(item_results(spark, d), "item_id").select(F.col("label").alias("input_id"), "item_id", (F.col("item_id") % 3).alias("query_group"), "vec", (F.col("score") + (F.col("item_id") % 7) / 10).alias("score"), F.col("item_id").alias("seq"), "valid")


SCORED = f"{LIB}, {RES}, sc as (select lib.label as input_id, lib.item_id, lib.item_id % 3 as query_group, lib.vec, res.score + (lib.item_id % 7) / 10 as score, lib.item_id as seq, res.valid from lib join res using (item_id))"
ADV = f"{SCORED}, ok as (select * from sc where valid), top as (select * from (select *, row_number() over (partition by input_id order by score desc, seq desc) as n from ok) where n = 1), adv as (select ok.*, (score - avg(score) over (partition by input_id)) / (stddev_pop(score) over (partition by input_id) + 1e-8) as a from ok)"


@register("advantages", f"with {SCORED} select input_id, item_id, round((score - avg(score) over (partition by input_id)) / (stddev_pop(score) over (partition by input_id) + 1e-8), 6) as advantage from sc")
def advantages(spark, d):
    return R.advantages(scored(spark, d), ["input_id"]).select("input_id", "item_id", F.round("advantage", 6).alias("advantage"))


TERMS = "t as (select adv.input_id, adv.a, adv.vec as e, top.vec as q, list_inner_product(adv.vec, top.vec) as dp, sqrt(list_inner_product(adv.vec, adv.vec)) as en, sqrt(list_inner_product(top.vec, top.vec)) as qn from adv join top using (input_id)), x as (select input_id, a, dp, en, qn, unnest(e) as e, unnest(q) as q, generate_subscripts(e, 1) as i from t)"


def gradient_sql(expression: str, base: str = ADV) -> str:
    return f"with {base}, {TERMS} select input_id, cast(i - 1 as bigint) as i, round({expression}, 6) + 0 as g from x group by input_id, i"


GRADIENT = {"euclid": "avg(2 * a * (q - e)) / 64", "cosine": "avg(a * dp / (qn * en)) * any_value(q) / (any_value(qn) * any_value(qn)) - avg(a * e / (qn * en))", "dot": "avg(a * e)"}


def flat(gradient: DataFrame, *keys: str) -> DataFrame:
    return gradient.select(*keys, F.posexplode("gradient").alias("i", "g")).select(*keys, F.col("i").cast("long").alias("i"), (F.round("g", 6) + 0).alias("g"))


def _gradient(metric: str):
    def query(spark, d):
        rows = R.advantages(scored(spark, d).filter("valid"), ["input_id"])
        return flat(S.gradients(rows, S.top_result(rows, ["input_id"]), ["input_id"], metric), "input_id")

    return query


for _metric, _expression in GRADIENT.items():
    register(f"gradient_{_metric}", gradient_sql(_expression))(_gradient(_metric))


@register("update_global", gradient_sql(GRADIENT["cosine"]))
def update_global(spark, d):
    return flat(S.update(scored(spark, d), ["input_id"], "cosine"), "input_id")


GROUPED = f"{SCORED}, ok as (select * from sc where valid), top as (select * from (select *, row_number() over (partition by input_id order by score desc, seq desc) as n from ok) where n = 1), ok2 as (select ok.* from ok join (select input_id, query_group from top) using (input_id, query_group)), adv as (select ok2.*, (score - avg(score) over (partition by input_id)) / (stddev_pop(score) over (partition by input_id) + 1e-8) as a from ok2)"


@register("update_group", gradient_sql(GRADIENT["euclid"], GROUPED))
def update_group(spark, d):
    return flat(S.update(scored(spark, d), ["input_id"], "euclid", group=True), "input_id")


@register("gradient_inputs", f"with {LIB}, p as (select item_id // 2 as product, item_id % 2 as assembly_index, item_id, vec from lib) select product, assembly_index, item_id, round(vec[1], 6) as first from p")
def gradient_inputs(spark, d):
    parents = library(spark, d).groupBy(F.expr("item_id div 2").alias("product")).agg(F.collect_list(F.struct((F.col("item_id") % 2).alias("assembly_index"), "item_id", "vec")).alias("parents"))
    return parents.select("product", F.inline("parents")).select("product", "assembly_index", "item_id", F.round(F.element_at("vec", 1), 6).alias("first"))


@register("build_queries", f"with {LIB}, r as (select embedding_id as assembly_index, item_id // 2 as input_id, vec, unnest(case when embedding_id = 0 then [0.0, 1.0, 2.0] else [0.0, 1.5] end) as rate, unnest(case when embedding_id = 0 then [0, 1, 2] else [0, 1] end) as query_group from lib), w as (select input_id, query_group from r group by 1, 2 having count(distinct assembly_index) = 2) select input_id, assembly_index, cast(query_group as bigint) as query_group, count(*) as n, round(sum(vec[1] * (1 - rate)), 6) as first from r join w using (input_id, query_group) group by 1, 2, 3")
def build_queries(spark, d):
    rates = F.when(F.col("embedding_id") == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.5)))
    state = library(spark, d).select(F.expr("item_id div 2").alias("input_id"), F.col("embedding_id").alias("assembly_index"), "vec", F.col("vec").alias("gradient"), rates.alias("rates"))
    groups = S.whole_groups(S.step_embeddings(state, ["input_id", "assembly_index"]), ["input_id"], 2)
    return groups.groupBy("input_id", "assembly_index", F.col("query_group").cast("long").alias("query_group")).agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("vec", 1)), 6).alias("first"))


@register("search_single", f"{COSINE}, {RES} select f.query_id, f.item_id, f.rank, lib.external_id from f join lib using (item_id)")
def search_single(spark, d):
    queries = asked(spark, d).select("query_id", "vec", F.lit(0).alias("query_group"))
    return S.search_single(queries, library(spark, d), 10, "cosine").select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "external_id")


POOLS = f"{LIB}, q as (select item_id // 200 as input_id, item_id // 100 % 2 as assembly_index, vec from lib where item_id % 100 = 0), h as (select * from (select q.input_id, q.assembly_index, lib.item_id, lib.external_id, row_number() over (partition by q.input_id, q.assembly_index order by {COS} desc, lib.item_id) as rank from q join lib on lib.embedding_id = q.assembly_index) where rank <= 3 + 2 * assembly_index)"
PRODUCTS = f"{POOLS}, pr as (select a.input_id, a.item_id as item_id_0, b.item_id as item_id_1, a.external_id || '.' || b.external_id as product from h a join h b using (input_id) where a.assembly_index = 0 and b.assembly_index = 1)"


def _products(spark, d):
    lib = library(spark, d).withColumn("item", F.col("external_id"))
    queries = lib.filter("item_id % 100 = 0").select(F.expr("item_id div 200").alias("input_id"), F.lit(0).alias("query_group"), F.expr("item_id div 100 % 2").alias("assembly_index"), "vec")
    queries = queries.withColumn("k", 3 + 2 * F.col("assembly_index"))
    return S.search_assembled(queries, lib, 2, "cosine", lambda parts: F.concat_ws(".", *parts))


@register("search_assembled", f"with {PRODUCTS} select input_id, item_id_0, item_id_1, product from pr")
def search_assembled(spark, d):
    return _products(spark, d).select("input_id", "item_id_0", "item_id_1", "product")


@register("search_mapped", f"with {LIB}, qq as (select item_id as input_id, vec from lib where item_id % 100 = 0), q as (select input_id, 0 as assembly_index, list_transform(vec, lambda x: x * 0.5) as vec from qq union all select input_id, 1, list_transform(vec, lambda x: -x) from qq), h as (select * from (select q.input_id, q.assembly_index, lib.item_id, lib.external_id, lib.vec, row_number() over (partition by q.input_id, q.assembly_index order by {COS} desc, lib.item_id) as rank from q join lib on lib.embedding_id = q.assembly_index) where rank <= 4) select a.input_id, a.external_id || '.' || b.external_id as product, round((a.vec[1] + b.vec[1]) / 2, 6) as first from h a join h b using (input_id) where a.assembly_index = 0 and b.assembly_index = 1")
def search_mapped(spark, d):
    lib = library(spark, d).withColumn("item", F.col("external_id"))
    queries = lib.filter("item_id % 100 = 0").select(F.col("item_id").alias("input_id"), F.lit(0).alias("query_group"), "vec")
    outputs = F.array(V.scale(F.col("vec"), F.lit(0.5)), V.scale(F.col("vec"), F.lit(-1.0)))
    asked_ = roles.mapped(queries, outputs).withColumn("k", F.lit(4))
    found = S.search_assembled(asked_, lib, 2, "cosine", lambda parts: F.concat_ws(".", *parts))
    embedded = F.zip_with("vec_0", "vec_1", lambda x, y: (x + y) / 2)  # the product's own vector, for the update
    return found.select("input_id", "product", F.round(F.element_at(embedded, 1), 6).alias("first"))


@register("assembly_pool_product", "select o.o_custkey as parent_id, o.o_orderkey as job_id_0, p.o_orderkey as job_id_1 from orders o join orders p using (o_custkey) where o.o_orderstatus = 'O' and p.o_orderstatus = 'F' and o.o_orderpriority = p.o_orderpriority")
def assembly_pool_product(spark, d):
    from vecclimb.queries.standins import jobs

    rows = jobs(spark, d)
    pools = [rows.filter(F.col("status") == s).select("parent_id", "priority", "job_id") for s in ("created", "complete")]
    return R.pool_product(pools, ["parent_id", "priority"]).select("parent_id", "job_id_0", "job_id_1")


@register("seed_query_product", f"with {POOLS} select a.input_id, a.item_id as item_id_0, b.item_id as item_id_1 from h a join h b using (input_id) where a.assembly_index = 0 and b.assembly_index = 1")
def seed_query_product(spark, d):
    return _products(spark, d).select("input_id", "item_id_0", "item_id_1")


BEST = f"""with {LIB}, q as (select item_id as input_id, vec from lib where item_id % 100 = 0),
h as (select q.input_id, lib.label % 3 as pool, lib.item_id, round({COS}, 6) as s, row_number() over (partition by q.input_id, lib.label % 3 order by round({COS}, 6) desc, lib.item_id) as r from q, lib),
p as (select * from h where r <= 20),
two as (select a.input_id, a.item_id as item_id_0, b.item_id as item_id_1, a.r as r0, b.r as r1, a.s + b.s as t from p a join p b using (input_id) where a.pool = 0 and b.pool = 1),
three as (select two.*, c.item_id as item_id_2, t + c.s as total, c.r as r2 from two join p c using (input_id) where c.pool = 2)
select input_id, item_id_0, item_id_1, item_id_2, round(total, 6) as total, n as place from (select *, row_number() over (partition by input_id order by total desc, t desc, r0, r1, r2) as n from three) where n <= 40"""


@register("best_products", BEST)
def best_products(spark, d):
    """Of three pools of the 20 nearest the 40 best products of every query, in place of 8,000."""
    lib = library(spark, d).withColumn("embedding_id", F.col("label") % 3)
    queries = lib.filter("item_id % 100 = 0").select(F.col("item_id").alias("input_id"), "vec").withColumn("pool", F.explode(F.array(*map(F.lit, range(3)))))
    asked_ = queries.select((F.col("input_id") * 3 + F.col("pool")).alias("query_id"), F.col("pool").alias("embedding_id"), "vec")
    hits = K.knn(asked_, lib, 30).withColumn("s", F.round("similarity", 6))  # ties of rounded similarities go by item
    pools = []
    for i in range(3):
        own = hits.filter(F.col("query_id") % 3 == i).select(F.expr("query_id div 3").alias("input_id"), "item_id", "s")
        pools.append(K.top_k(own, ["input_id"], [F.desc("s"), F.col("item_id")], 20).drop("rank"))
    found = R.best_products(pools, ["input_id"], 40, "s")
    return found.select("input_id", "item_id_0", "item_id_1", "item_id_2", F.round("total", 6).alias("total"), F.col("place").cast("long").alias("place"))


@register("score_iteration", f"{COSINE}, {RES}, m as (select f.query_id, f.item_id, f.rank, coalesce(d.n_chars between 100 and 5000, false) as valid from f join documents d on d.doc_id = f.item_id) select m.query_id, m.item_id, m.rank, m.valid and res.score is not null as valid, case when m.valid then res.score end as score from m left join res using (item_id)")
def score_iteration(spark, d):
    from vecclimb.operators.filters import cascade, in_range

    queries = asked(spark, d).select("query_id", "vec", F.lit(0).alias("query_group"))
    found = S.search_single(queries, library(spark, d), 10, "cosine").join(items(spark, d).select("item_id", "n_chars"), "item_id")
    kept = cascade(found.withColumn("valid", F.lit(True)), [in_range(F.col("n_chars"), 100, 5000)])
    scores = item_results(spark, d).select("item_id", F.col("score").alias("s"))
    out = kept.join(scores, "item_id", "left")
    return out.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), (F.col("valid") & F.col("s").isNotNull()).alias("valid"), F.when(F.col("valid"), F.col("s")).alias("score"))


@register("run_job")
def run_job(spark, d):
    seeds = library(spark, d).filter("item_id % 100 = 0").select(F.col("item_id").alias("input_id"), "vec")
    return S.run_job(S.Job(library(spark, d), _by_labels(spark, d)), seeds).select("input_id", "iteration", "query_group", "item_id", F.round("similarity", 6).alias("similarity"), "valid", "score", "fresh")


def _by_labels(spark, d):
    """A score from the labels; items without one are invalid."""
    results = item_results(spark, d)
    return lambda rows: rows.join(results, "item_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


@register("run_job_embeddings", f"with {LIB}, {RES}, e as (select item_id // 200 as input_id, item_id as no, vec from lib where item_id % 100 = 0), q as (select input_id, row_number() over (partition by input_id order by no) - 1 as query_no, vec from e), h as (select * from (select q.input_id, q.query_no, lib.item_id, round({COS}, 6) as similarity, row_number() over (partition by q.input_id, q.query_no order by {COS} desc, lib.item_id) as n from q, lib) where n <= 10) select h.input_id, h.query_no, h.item_id, h.similarity, coalesce(res.valid, false) as valid, res.score from h left join res using (item_id)")
def run_job_embeddings(spark, d):
    """The first iteration of a job whose inputs have several embeddings, each a query of its own."""
    seeds = library(spark, d).filter("item_id % 100 = 0").select(F.expr("item_id div 200").alias("input_id"), F.col("item_id").alias("embedding_no"), "vec")
    found = S.run_job(S.Job(library(spark, d), _by_labels(spark, d), max_iterations=1), seeds)
    return found.select("input_id", "query_no", "item_id", F.round("similarity", 6).alias("similarity"), "valid", "score")


CHAIN = f"""{LIB}, {RES}, p as (select *, item_id // 100 as seed_no from lib where item_id % 100 = 0),
q1 as (select item_id as seed, 'fresh' as origin, vec from p order by seed_no limit 3),
h1 as (select q.seed, q.origin, lib.item_id, row_number() over (partition by q.seed, q.origin order by {COS} desc, lib.item_id) as n from q1 q, lib),
r1 as (select 0 as run, seed, origin, item_id, coalesce(valid, false) as valid, score from h1 left join res using (item_id) where n <= 10),
best as (select distinct item_id, score from r1 where valid and score is not null order by score desc, item_id limit 1),
q2 as (select item_id as seed, 'best' as origin, lib.vec from best join lib using (item_id) union all select * from (select item_id, 'fresh', vec from p order by seed_no limit 2 offset 3)),
h2 as (select q.seed, q.origin, lib.item_id, row_number() over (partition by q.seed, q.origin order by {COS} desc, lib.item_id) as n from q2 q, lib),
r2 as (select 1 as run, seed, origin, item_id, coalesce(valid, false) as valid, score from h2 left join res using (item_id) where n <= 10)"""


@register("explore_exploit_chain", f"with {CHAIN} select cast(run as bigint) as run, origin, cast(case origin when 'fresh' then seed // 100 else seed end as varchar) as seed, item_id, valid, score from (select * from r1 union all select * from r2)")
def explore_exploit_chain(spark, d):
    """Two jobs of one iteration: three fresh seeds, then two fresh ones and the best item of the first."""
    pool = library(spark, d).filter("item_id % 100 = 0").select(F.expr("item_id div 100").alias("seed_no"), "vec")
    found = S.chain(S.Job(library(spark, d), _by_labels(spark, d), max_iterations=1), pool, 3, 0.6, 1_000_000, most_runs=2)
    return found.results.select(F.col("run").cast("long").alias("run"), "origin", "seed", "item_id", "valid", "score")


def _score_of_product(rows: DataFrame) -> DataFrame:
    """A score of the two parents' numbers in a product's text; some products are invalid."""
    a, b = (F.split_part("item", F.lit("."), F.lit(i)).cast("long") for i in (1, 2))
    return rows.withColumns({"valid": (a + b) % 5 != 0, "score": F.when((a + b) % 5 != 0, ((a * 7 + b * 3) % 101).cast("double"))})


def _product_filter(rows: DataFrame) -> DataFrame:
    a, b = (F.split_part("item", F.lit("."), F.lit(i)).cast("long") for i in (1, 2))
    return rows.withColumn("valid", F.col("valid") & ((a + b) % 7 != 3))


def _product_job(spark, d, **options) -> S.Job:
    lib = library(spark, d).withColumn("item", F.col("external_id"))
    return S.Job(lib, _score_of_product, k=4, positions=2, assemble=lambda parts: F.concat_ws(".", *parts), filters=_product_filter, **options)


JUDGED = "ok as (select *, (a + b) % 7 <> 3 and (a + b) % 5 <> 0 as valid from pr) select input_id, product, valid, case when valid then cast((a * 7 + b * 3) % 101 as double) end as score from ok"


@register("run_job_first", f"{COSINE}, {RES} select f.query_id as input_id, f.item_id, f.similarity, coalesce(res.valid, false) as valid, res.score from f left join res using (item_id)")
def run_job_first(spark, d):
    """The first iteration of run_job, which SQL can express."""
    seeds = library(spark, d).filter("item_id % 100 = 0").select(F.col("item_id").alias("input_id"), "vec")
    return S.run_job(S.Job(library(spark, d), _by_labels(spark, d), max_iterations=1), seeds).select("input_id", "item_id", F.round("similarity", 6).alias("similarity"), "valid", "score")


@register("run_job_assembled", f"with {LIB}, q as (select item_id // 200 as input_id, item_id // 100 % 2 as assembly_index, vec from lib where item_id % 100 = 0), h as (select * from (select q.input_id, q.assembly_index, lib.item_id, lib.external_id, row_number() over (partition by q.input_id, q.assembly_index order by {COS} desc, lib.item_id) as rank from q join lib on lib.embedding_id = q.assembly_index) where rank <= 4), pr as (select a.input_id, a.external_id || '.' || b.external_id as product, a.item_id as a, b.item_id as b from h a join h b using (input_id) where a.assembly_index = 0 and b.assembly_index = 1), {JUDGED}")
def run_job_assembled(spark, d):
    """One iteration of a job over products of two positions; the tests run more."""
    seeds = library(spark, d).filter("item_id % 100 = 0").select(F.expr("item_id div 200").alias("input_id"), F.expr("item_id div 100 % 2").alias("assembly_index"), "vec")
    return S.run_job(_product_job(spark, d, max_iterations=1), seeds).select("input_id", F.col("item").alias("product"), "valid", "score")


@register("run_job_mapped", f"with {LIB}, qq as (select item_id as input_id, vec from lib where item_id % 100 = 0), q as (select input_id, 0 as assembly_index, list_transform(vec, lambda x: x * 0.5) as vec from qq union all select input_id, 1, list_transform(vec, lambda x: -x) from qq), h as (select * from (select q.input_id, q.assembly_index, lib.item_id, lib.external_id, row_number() over (partition by q.input_id, q.assembly_index order by {COS} desc, lib.item_id) as rank from q join lib on lib.embedding_id = q.assembly_index) where rank <= 4), pr as (select a.input_id, a.external_id || '.' || b.external_id as product, a.item_id as a, b.item_id as b from h a join h b using (input_id) where a.assembly_index = 0 and b.assembly_index = 1), {JUDGED}")
def run_job_mapped(spark, d):
    """One iteration of a job whose query vector is mapped to two positions; the tests run more."""
    outputs = F.array(V.scale(F.col("vec"), F.lit(0.5)), V.scale(F.col("vec"), F.lit(-1.0)))
    middle = lambda vectors: F.zip_with(*vectors, lambda x, y: (x + y) / 2)
    seeds = library(spark, d).filter("item_id % 100 = 0").select(F.col("item_id").alias("input_id"), "vec")
    job = _product_job(spark, d, max_iterations=1, mapper=lambda rows: roles.mapped(rows, outputs), embed=middle)
    return S.run_job(job, seeds).select("input_id", F.col("item").alias("product"), "valid", "score")

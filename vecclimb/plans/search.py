"""Search plans: build queries, search, combine, score, update, repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.functions.scalars import over_limit
from vecclimb.functions.vectors import dot, norm, step
from vecclimb.operators.knn import knn, knn_to_items
from vecclimb.operators.relations import best_products, pool_product
from vecclimb.operators.sums import mean_vectors, tops_and_gradients
from vecclimb.operators.windows import last_wins, top_result
from vecclimb.plans.journal import Journal
from vecclimb.session import Workspace, ship


def gradients(rows: DataFrame, tops: DataFrame, keys: list[str], metric: str, dot_as_distance: bool = False) -> DataFrame:
    """keys and gradient: the gradient at each top's vec from rows with vec and advantage.

    It is the mean of a term a row. Terms are linear in the rows' weighted vectors, so these are summed in the tasks before the only
    shuffle, and the top joins their means. The Dot form is that of the plain product, which points away from good
    items; dot_as_distance turns it round.
    """
    w = F.col("advantage")
    weighted = rows.withColumn("_w", w / norm(F.col("vec")) if metric == "cosine" else w)
    terms = weighted.select(*keys, F.concat(F.array(w), F.transform("vec", lambda e: F.col("_w") * e)).alias("vec"))
    means = mean_vectors(terms.filter("vec is not null"), keys).select(*keys, F.element_at("vec", 1).alias("_a"), F.expr("slice(vec, 2, size(vec) - 1)").alias("_m"))
    q, m = F.col("_q"), F.col("_m")
    joined = means.join(tops.select(*keys, F.col("vec").alias("_q")), keys)
    if metric == "euclid":
        gradient = F.zip_with(q, m, lambda x, y: 2 * (x * F.col("_a") - y) / F.size(q))
    elif metric == "cosine":
        joined = joined.withColumn("_x", dot(q, m) / dot(q, q)).withColumn("_n", norm(q))
        gradient = F.zip_with(q, m, lambda x, y: (F.col("_x") * x - y) / F.col("_n"))
    else:
        gradient = F.transform(m, lambda y: -y) if dot_as_distance else m
    return joined.select(*keys, gradient.alias("gradient"))


def step_embeddings(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query_group, vec: group 0 is vec itself, then vec - rate * gradient for each rate.

    state: keys, vec, gradient (or null: group 0 alone), rates. Positions of an assembly meet later by
    query_group, so that rate lists of different lengths end with the shortest.
    """
    rates = F.when(F.col("gradient").isNull(), F.array(F.lit(None).cast("double"))).otherwise(F.concat(F.array(F.lit(None).cast("double")), F.col("rates")))
    rows = state.select(*keys, "vec", "gradient", F.posexplode(rates).alias("query_group", "rate"))
    moved = F.when(F.col("rate").isNull(), F.col("vec")).otherwise(step(F.col("vec"), F.col("gradient"), F.col("rate")))
    return rows.select(*keys, "query_group", moved.alias("vec"))


def whole_groups(groups: DataFrame, keys: list[str], positions: int) -> DataFrame:
    """Query groups that every position has (L1)."""
    full = groups.groupBy(*keys, "query_group").agg(F.count_distinct("assembly_index").alias("n")).filter(F.col("n") == positions)
    return groups.join(full.drop("n"), [*keys, "query_group"])


def search_single(queries: DataFrame, library: DataFrame, k: int, metric: str) -> DataFrame:
    """Candidates from one library: hits with item columns and query group (L2)."""
    return knn_to_items(queries, library, k, metric)


def search_pools(queries: DataFrame, library: DataFrame, metric: str, keys: tuple[str, ...] = ("input_id", "query_group")) -> DataFrame:
    """Hits of each position's query in the library of its position, with its own k.

    queries: keys, assembly_index, vec, k; library: embedding_id = position. Hits bring item and vec along.
    """
    asked = queries.withColumns({"query_id": F.xxhash64(*keys, "assembly_index"), "embedding_id": F.col("assembly_index")})
    hits = knn(asked, library, metric=metric, carry=["item", "vec"])
    return hits.join(asked.select("query_id", *keys, "assembly_index"), "query_id")


def search_assembled(queries: DataFrame, library: DataFrame, positions: int, metric: str, assemble: Callable[[list[Column]], Column], keys: tuple[str, ...] = ("input_id", "query_group"), best: int | None = None) -> DataFrame:
    """Products of one parent of each position, within the keys: input and query group, and the query where there are several (L3).

    (keys, item_id_i, vec_i, rank_i ..., product). With best only so many within the keys, those of the greatest sums of
    similarities, found without the whole product.
    """
    hits = search_pools(queries, library, metric, keys)
    pools = [hits.filter(F.col("assembly_index") == i).select(*keys, "item_id", "item", "vec", "rank", "similarity") for i in range(positions)]
    met = pool_product([p.drop("similarity") for p in pools], list(keys)) if best is None else best_products(pools, list(keys), best, "similarity")
    return met.withColumn("product", assemble([F.col(f"item_{i}") for i in range(positions)]))


def fan_out(config: DataFrame, positions: int) -> DataFrame:
    """One library's configuration for every position."""
    return config.select("*", F.explode(F.sequence(F.lit(0), F.lit(positions - 1))).alias("assembly_index"))


def update(scored: DataFrame, keys: list[str], metric: str, group: bool = False) -> DataFrame:
    """keys, vec, gradient of the next state, from scored candidates.

    scored: keys, item_id, query_group, vec, score, seq, valid. The top is the best valid row, the last of
    equals; with group only its query group counts. An item counts once, by its last row in order
    of score. A single result has no advantage and so no gradient.
    """
    valid = scored.filter("valid and score is not null")
    if group:
        tops = top_result(valid, keys)
        valid = valid.join(tops.select(*keys, "query_group"), [*keys, "query_group"], "left_semi")
    unique = last_wins(valid.select(*keys, "item_id", "vec", "score", "seq"), [*keys, "item_id"], F.desc("score"), F.desc("seq"))
    return tops_and_gradients(unique, keys, metric)


def should_stop(state: DataFrame, now: Column, name: str = "status") -> DataFrame:
    """state with stop and status, or whatever name it is to have.

    state: iteration, max_iterations, has_queries, inference, inference_limit, started_at, time_limit and
    the same of the parent with the prefix parent_. Limits are strict and checked after an iteration.
    """
    finish = F.col("iteration") >= F.col("max_iterations") - 1
    late = lambda at: F.unix_timestamp(now) - F.unix_timestamp(at)
    early = over_limit(F.col("inference"), F.col("inference_limit")) | over_limit(late("started_at"), F.col("time_limit")) | over_limit(F.col("parent_inference"), F.col("parent_inference_limit")) | over_limit(late("parent_started_at"), F.col("parent_time_limit"))
    return state.withColumn("stop", finish | ~F.col("has_queries") | early).withColumn(name, F.when(finish & ~early & F.col("has_queries"), "complete").otherwise("early_stop"))


def explore_exploit(results: DataFrame, seeds: DataFrame, used: DataFrame, n: int, explore: float) -> DataFrame:
    """The next job's n seeds: the best int(n * (1 - explore)) of the last run, and fresh ones."""
    best = int(n * (1 - explore)) if results is not None else 0
    out = seeds.join(used, "item_id", "left_anti").orderBy("seed_no").limit(n - best).select("item_id", F.lit("fresh").alias("origin"))
    if best:
        out = out.unionByName(results.filter("score is not null").orderBy(F.desc("score"), "item_id").limit(best).select("item_id", F.lit("best").alias("origin")))
    return out


#: Rules of a stage whose texts one broadcast trie may hold; more meet by the lengths of their texts.
MOST_RULES = 100_000


def _trie(texts: list[str], backwards: bool) -> dict:
    """Nested dicts by character; the number of a text stands under "" where it ends."""
    root: dict = {}
    for no, text in enumerate(texts):
        at = root
        for c in reversed(text) if backwards else text:
            at = at.setdefault(c, {})
        at[""] = no
    return root


def affixes(rows: DataFrame, column: str, texts: list[str], backwards: bool) -> DataFrame:
    """(column, no): for each row every text, by its number, that the row's ends with (backwards) or begins with.

    One walk along a trie of all texts finds those of every length, and a row is repeated for those that it has alone.
    """
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _trie(held.value, backwards)
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(0).to_pylist()):
                node = root if value is not None else {}
                if "" in node:
                    at.append(i), found.append(node[""])
                for c in reversed(value or "") if backwards else value or "":
                    node = node.get(c)
                    if node is None:
                        break
                    if "" in node:
                        at.append(i), found.append(node[""])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int32())], names=[column, "no"])

    return rows.select(column).mapInArrow(run, f"{column} string, no int")


def _by_trie(products: DataFrame, parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(product, sep, part) of all pairs that a rule allows."""
    lefts, rights = (sorted({r[i] for r in rules}) for i in (0, 1))
    number = [{t: n for n, t in enumerate(texts)} for texts in (lefts, rights)]
    allowed = products.sparkSession.createDataFrame([(number[0][a], number[1][b], c) for a, b, c in rules], "l int, r int, sep string")
    ends = affixes(products, "product", lefts, True).withColumnRenamed("no", "l")
    begins = affixes(parts, "part", rights, False).withColumnRenamed("no", "r")
    return ends.join(F.broadcast(allowed), "l").join(begins, "r")


def _by_lengths(products: DataFrame, parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: a row stands for each of its ends or beginnings as long as any rule's."""
    sizes = rules.agg(F.collect_set(F.length("left")), F.collect_set(F.length("right"))).first()
    cuts = lambda sizes: F.explode(F.array(*map(F.lit, sorted(sizes))))
    ends = products.select("product", cuts(sizes[0]).alias("_n")).filter(F.length("product") >= F.col("_n")).select("product", F.expr("right(product, _n)").alias("left"))
    begins = parts.select("part", cuts(sizes[1]).alias("_n")).filter(F.length("part") >= F.col("_n")).select("part", F.expr("left(part, _n)").alias("right"))
    return ends.join(rules, "left").join(begins, "right")


def staged_assembly(first: DataFrame, parents: DataFrame, rules: DataFrame, stages: int) -> DataFrame:
    """Products of stages: a product that fits a rule's left side meets the parents that fit its right.

    first: product; parents: stage, part; rules: stage, left, right, sep (texts that products end, and parts begin, with; null fits
    nothing). Up to MOST_RULES rules of a stage are two broadcast tries, which give the rules' numbers that a product or a part fits, so that
    both meet by equality; more meet by the texts. A stage's products are distinct; where it has several rules all their products go on.
    """
    current = first.select("product").filter("product is not null").distinct()
    for s in range(stages):
        rule = rules.filter(F.col("stage") == s).select("left", "right", F.coalesce("sep", F.lit("")).alias("sep")).filter("left is not null and right is not null").distinct()
        parts = parents.filter(F.col("stage") == s).select("part").filter("part is not null").distinct()
        held = rule.limit(MOST_RULES + 1).collect()
        if not held:
            return current.limit(0)
        met = _by_trie(current, parts, [tuple(r) for r in held]) if len(held) <= MOST_RULES else _by_lengths(current, parts, rule)
        current = met.select(F.concat("product", "sep", "part").alias("product")).distinct()
    return current


def symmetric_assembly(pairs: DataFrame, left: str, right: str, assemble: Callable[[Column, Column], Column]) -> DataFrame:
    """Products of either order of the parents, each once."""
    one = pairs.select(assemble(F.col(left), F.col(right)).alias("product"))
    return one.union(pairs.select(assemble(F.col(right), F.col(left)).alias("product"))).distinct()


@dataclass
class Job:
    """A search job: seeds climb towards items of high score.

    Without assemble, candidates are items of the library. With it they are products of one parent of each
    of `positions` positions, found by a query vector a position; with a mapper as well, one query vector gives
    the vectors of all positions, and embed gives the product's own vector, on which the climb goes on.
    """

    library: DataFrame
    score: Callable[[DataFrame], DataFrame]  # rows with item_id, item, vec, vecs: adds valid and score
    k: int = 10
    metric: str = "cosine"
    rates: list[float] = field(default_factory=lambda: [0.5, 1.0, 2.0])
    max_iterations: int = 3
    inference_limit: int | None = None  # of all inputs together
    time_limit: int | None = None
    group: bool = False
    positions: int = 1
    assemble: Callable[[list[Column]], Column] | None = None
    products: int | None = None  # best products of a query group; all of them otherwise
    mapper: Callable[[DataFrame], DataFrame] | None = None  # input_id, query_no, query_group, vec -> rows with assembly_index and vec
    embed: Callable[[list[Column]], Column] | None = None  # vectors of the parents -> vector of the product
    filters: Callable[[DataFrame], DataFrame] | None = None  # rows as for score, with valid: may set it to false


    def settings(self) -> str:
        """What must be the same for a broken-off run to go on."""
        return repr((self.k, self.metric, self.rates, self.max_iterations, self.inference_limit, self.time_limit, self.group, self.positions, self.products))


@dataclass
class JobRun:
    """results: a row a candidate; inputs: (input_id, iterations, inference, status); log: a row an iteration; scores: items scored."""

    results: DataFrame
    inputs: DataFrame
    log: DataFrame
    scores: DataFrame
    inference: int


QUERY = ("input_id", "query_no")


def query_seeds(seeds: DataFrame, positions: int) -> DataFrame:
    """(input_id, query_no, assembly_index, vec): a query for every combination of one embedding of each position.

    seeds: input_id, vec, assembly_index where there are several positions, embedding_no where a position of an input has several
    embeddings (without it they are ordered by their numbers). Combinations are numbered in the order of the first position's embeddings,
    then the second's and so on. An input that lacks a position has no query.
    """
    at = F.col("assembly_index").cast("int") if "assembly_index" in seeds.columns else F.lit(0)
    order = [F.col("embedding_no")] if "embedding_no" in seeds.columns else []
    numbered = seeds.filter("vec is not null").select("input_id", at.alias("assembly_index"), F.col("vec").cast("array<double>").alias("vec"), *order)
    within = Window.partitionBy("input_id", "assembly_index")
    numbered = numbered.withColumns({"_no": F.row_number().over(within.orderBy(*order, "vec")) - 1, "_n": F.count("*").over(within)})
    pools = [numbered.filter(F.col("assembly_index") == i).select("input_id", "vec", "_no", "_n") for i in range(positions)]
    both = pool_product(pools, ["input_id"])
    number = reduce(lambda n, i: n * F.col(f"_n_{i}") + F.col(f"_no_{i}"), range(positions), F.lit(0).cast("long"))
    each = F.array(*(F.struct(F.lit(i).alias("assembly_index"), F.col(f"vec_{i}").alias("vec")) for i in range(positions)))
    return both.select("input_id", number.alias("query_no"), F.inline(each))


def candidates(job: Job, groups: DataFrame) -> DataFrame:
    """(input_id, query_no, query_group, item_id, item, similarity, place, vecs) of groups (input_id, query_no, assembly_index, query_group, vec).

    vecs holds the vector of each position that the update goes on from; a product's id is a hash of its text. place orders
    the candidates of a query group.
    """
    keys = (*QUERY, "query_group")
    one = lambda vec: F.array(F.struct(F.lit(0).alias("assembly_index"), vec.alias("vec")))
    if job.assemble is None:
        asked = groups.select(F.xxhash64(*keys).alias("query_id"), *keys, "vec")
        hits = knn(asked, job.library, job.k, job.metric, ["external_id", "vec"]).join(asked.select("query_id", *keys), "query_id")
        return hits.select(*keys, "item_id", F.col("external_id").alias("item"), "similarity", F.col("rank").cast("long").alias("place"), one(F.col("vec")).alias("vecs"))
    asked = job.mapper(groups.select(*keys, "vec")) if job.mapper else groups
    found = search_assembled(asked.withColumn("k", F.lit(job.k)), job.library, job.positions, job.metric, job.assemble, keys, job.products)
    vectors = [F.col(f"vec_{i}") for i in range(job.positions)]
    vecs = one(job.embed(vectors)) if job.mapper else F.array(*(F.struct(F.lit(i).alias("assembly_index"), v.alias("vec")) for i, v in enumerate(vectors)))
    place = sum((F.col(f"rank_{i}") * (job.k + 1) ** (job.positions - 1 - i) for i in range(job.positions)), F.lit(0).cast("long"))
    return found.select(*keys, F.xxhash64("product").alias("item_id"), F.col("product").alias("item"), F.lit(None).cast("double").alias("similarity"), place.alias("place"), vecs.alias("vecs"))


def run(job: Job, seeds: DataFrame, name: str = "job", at: str | None = None, scored: DataFrame | None = None) -> JobRun:
    """All iterations of a job over all its inputs.

    seeds: see query_seeds(); further, where inputs differ, max_iterations, inference_limit and time_limit (the same in all rows of
    an input). Each query of an input climbs on its own. All advance together, one plan an iteration: queries, search,
    filters, score, update. An item is scored once in a job, and not at all if it is in scored (item_id, valid, score), which earlier
    jobs left; it counts as inference of the least input that asks for it then. After each iteration should_stop() decides for
    every input; counts of the scored items and of the inputs that go on are all that goes to the driver.

    An iteration is four steps: candidates found, new items scored, the next state, the inputs. Each is a table in the job's
    folder and an entry in its journal. With at, the folder of a run that broke off, steps that were committed are read and the rest is
    done, so that the results are those of an unbroken run and no item that was scored is scored again; other settings than
    that run's are an error.
    """
    spark = seeds.sparkSession
    work = Journal(spark, at or Workspace(spark, name).path, job.settings())
    started = F.lit(work.started)
    rates = F.array(*map(F.lit, job.rates))
    keys = [*QUERY, "assembly_index"]
    positions = 1 if job.assemble is None or job.mapper else job.positions
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)).cast("long") if c in seeds.columns else F.lit(default).cast("long")
    state = work.step("seeds", lambda: query_seeds(seeds, positions).select(*keys, "vec", F.lit(None).cast("array<double>").alias("gradient"), rates.alias("rates")))
    limits = seeds.select("input_id", optional("max_iterations", job.max_iterations).alias("max_iterations"), optional("inference_limit", None).alias("inference_limit"), optional("time_limit", None).alias("time_limit"))
    inputs = work.step("inputs", lambda: limits.groupBy("input_id").agg(*(F.max(c).alias(c) for c in limits.columns[1:])).withColumns({"inference": F.lit(0).cast("long"), "iterations": F.lit(0), "status": F.lit("running")}))
    none = StructType.fromDDL("item_id long, valid boolean, score double, fresh boolean, asked_by long")
    earlier = spark.createDataFrame([], "item_id long, valid boolean, score double") if scored is None else scored.select(F.col("item_id").cast("long").alias("item_id"), "valid", F.col("score").cast("double").alias("score"))
    tables: list[DataFrame] = []
    total, i = 0, 0
    while True:
        groups = whole_groups(step_embeddings(state, keys), list(QUERY), positions)
        found = work.step(f"found{i}", lambda: candidates(job, groups))  # noqa: B023 - steps are built at once
        known = earlier.unionByName(work.together("done", i, none).select("item_id", "valid", "score"))

        def judged_items() -> DataFrame:
            items = found.groupBy("item_id").agg(F.min("item").alias("item"), F.min("vecs").alias("vecs"), F.min("input_id").alias("asked_by")).withColumns({"vec": F.col("vecs")[0]["vec"], "valid": F.lit(True)})
            asked = items.join(known.select("item_id"), "item_id", "left_anti") if i or scored is not None else items
            if job.filters:
                asked = work.step(f"filtered{i}", lambda: job.filters(asked))
            out = job.score(asked.filter("valid").drop("valid")).select("item_id", "valid", "score", F.lit(True).alias("fresh"))
            if job.filters:
                out = out.unionByName(asked.filter("not valid").select("item_id", F.lit(False).alias("valid"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("fresh")))
            return out.join(asked.select("item_id", "asked_by"), "item_id").select("item_id", "valid", F.col("score").cast("double").alias("score"), "fresh", "asked_by")

        done = work.step(f"done{i}", judged_items, "done")
        total += done.filter("fresh").count()
        scores = done.select("item_id", "valid", "score", "fresh")
        if i or scored is not None:
            scores = scores.unionByName(known.withColumn("fresh", F.lit(False)))
        judged = found.join(scores, "item_id").withColumns({"seq": F.struct("query_group", "place", "item_id"), "iteration": F.lit(i)})
        tables.append(judged)
        rows = judged.select(*QUERY, "item_id", "query_group", "score", "seq", "valid", F.inline("vecs"))
        following = work.step(f"state{i}", lambda: update(rows, keys, job.metric, job.group).select(*keys, "vec", "gradient", rates.alias("rates")))

        def stopped_inputs() -> DataFrame:
            spent = done.filter("fresh").groupBy(F.col("asked_by").alias("input_id")).agg(F.count("*").alias("n"))
            alive = following.select("input_id").distinct().withColumn("has_queries", F.lit(True))
            now = inputs.join(spent, "input_id", "left").join(alive, "input_id", "left").withColumns({"inference": F.col("inference") + F.coalesce("n", F.lit(0)), "has_queries": F.coalesce("has_queries", F.lit(False)), "iteration": F.lit(i), "started_at": started})
            parent = {"parent_inference": F.lit(total), "parent_inference_limit": F.lit(job.inference_limit).cast("long"), "parent_started_at": started, "parent_time_limit": F.lit(job.time_limit).cast("long")}
            out = should_stop(now.withColumns(parent), F.current_timestamp(), "new_status")
            open_ = F.col("inputs.status") == "running"
            return out.alias("inputs").select("input_id", "max_iterations", "inference_limit", "time_limit", "inference", F.when(open_, F.lit(i + 1)).otherwise(F.col("iterations")).alias("iterations"), F.when(open_ & F.col("stop"), F.col("new_status")).otherwise(F.col("inputs.status")).alias("status"))

        inputs = work.step(f"inputs{i}", stopped_inputs)
        state = following.join(inputs.filter("status = 'running'").select("input_id"), "input_id", "left_semi")
        i += 1
        if inputs.filter("status = 'running'").isEmpty():
            break
    results = reduce(DataFrame.unionByName, tables)
    one_item = results.groupBy("iteration", "item_id").agg(F.count("*").alias("n"), F.bool_or("fresh").alias("fresh"), F.bool_or("valid").alias("valid"))
    log = one_item.groupBy("iteration").agg(F.sum("n").alias("candidates"), F.count("*").alias("unique_items"), F.count_if("fresh").alias("executed"), F.count_if(~F.col("valid")).alias("invalid"))
    return JobRun(results.drop("seq"), inputs.select("input_id", "iterations", "inference", "status"), log, work.together("done", i, none).select("item_id", "valid", "score"), total)


def run_job(job: Job, seeds: DataFrame, name: str = "job", at: str | None = None) -> DataFrame:
    """The results of run(): (input_id, query_no, iteration, query_group, item_id, item, similarity, valid, score, fresh)."""
    return run(job, seeds, name, at).results.drop("vecs", "place")


@dataclass
class Chain:
    """results: those of all runs, with run; best: the best items of all runs; inference: scores executed; runs: how many jobs."""

    results: DataFrame
    best: DataFrame
    inference: int
    runs: int


def best_items(results: DataFrame, n: int) -> DataFrame:
    """(item_id, item, vecs, score): the n best valid items of results, ties by the lesser id. The best of parts hold the best of all."""
    one = results.filter("valid and score is not null").groupBy("item_id", "score").agg(F.min("item").alias("item"), F.min("vecs").alias("vecs"))
    return one.orderBy(F.desc("score"), "item_id").limit(n).select("item_id", "item", "vecs", "score")


def chain(job: Job, pool: DataFrame, n: int, explore: float, budget: int, most_runs: int | None = None, seeds_of: Callable[[DataFrame], DataFrame] | None = None, keep: int = 1000, at: str | None = None) -> Chain:
    """Jobs in a row under one budget of inference, each from fresh seeds and the best items of the job before.

    pool: seed_no (distinct), vec, and assembly_index where the job has positions. A job takes the next seeds by seed_no as inputs, each once in
    the chain: n in the first, then n - int(n * (1 - explore)), with the best valid items of the last job for the rest. seeds_of gives (item_id, vec,
    assembly_index) of items (item_id, item, vecs); their own vectors otherwise. The chain ends when the budget is spent, no fresh
    seeds are left, or most_runs is reached; a job may spend what is left of the budget, which like any limit is checked
    after an iteration. Scores of earlier jobs are known to later ones. Of each job the `keep` best are merged into the best of all, so that
    this state does not grow with the runs. at: a folder of a chain that broke off, which then goes on in its last job.
    """
    if not 0 <= explore <= 1 or n < 1:
        raise ValueError("n is 1 or more and explore a share")
    spark = pool.sparkSession
    folder = at or Workspace(spark, "chain").path
    exploit = int(n * (1 - explore))
    given = [c for c in ("assembly_index", "embedding_no") if c in pool.columns]
    spent, runs, last = 0, 0, None
    tables: list[DataFrame] = []
    best: DataFrame | None = None
    top: DataFrame | None = None
    scored: DataFrame | None = None
    while spent < budget and (most_runs is None or runs < most_runs):
        chosen = top.limit(exploit) if top is not None and exploit else None
        fresh = pool if last is None else pool.filter(F.col("seed_no") > last)
        numbers = [r["seed_no"] for r in fresh.select("seed_no").distinct().orderBy("seed_no").limit(n if runs == 0 else n - exploit).collect()]  # n at most
        if not numbers:
            break
        last = numbers[-1]
        seeds = fresh.filter(F.col("seed_no") <= last).select(F.col("seed_no").cast("string").alias("_seed"), F.lit("fresh").alias("origin"), "vec", *given)
        if chosen is not None:
            own = seeds_of(chosen) if seeds_of else chosen.select("item_id", F.inline("vecs"))
            own = own.select(F.col("item_id").cast("string").alias("_seed"), F.lit("best").alias("origin"), "vec", *(c if c in own.columns else F.lit(0).alias(c) for c in given))
            seeds = own.unionByName(seeds)
        seeds = seeds.withColumn("input_id", F.xxhash64(F.lit(runs), "origin", "_seed"))
        work = Journal(spark, f"{folder}/run{runs}", "seeds")
        seeds = work.step("seeds", lambda: seeds)
        left = replace(job, inference_limit=budget - spent)
        done = run(left, seeds.drop("origin", "_seed"), at=f"{folder}/run{runs}/job", scored=scored)
        named = seeds.select("input_id", "origin", F.col("_seed").alias("seed")).distinct()
        tables.append(done.results.join(named, "input_id").withColumn("run", F.lit(runs)))
        top = work.step("top", lambda: best_items(done.results, max(keep, exploit)))
        merged = top if best is None else best_items(best.unionByName(top).withColumn("valid", F.lit(True)), max(keep, exploit))
        best = work.step("best", lambda: merged)
        scored = work.step("scored", lambda: done.scores if scored is None else scored.unionByName(done.scores))
        spent += done.inference
        runs += 1
    kind = "item_id long, item string, vecs array<struct<assembly_index:int,vec:array<double>>>, score double"
    if best is None:
        best = spark.createDataFrame([], kind)
        return Chain(best.withColumn("run", F.lit(0)), best, 0, 0)
    return Chain(reduce(DataFrame.unionByName, tables).drop("vecs", "place"), best.orderBy(F.desc("score"), "item_id").limit(keep), spent, runs)

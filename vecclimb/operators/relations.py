"""Joins, counts, set operations and retention over the store's tables (D, E, H, N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecclimb.functions.scalars import TERMINAL


def with_scores(results: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Results left-joined to item results: a result without score stays."""
    return results.join(scores, keys, "left")


def resolved_score_plugin(jobs: DataFrame, links: DataFrame, plugins: DataFrame) -> DataFrame:
    """(job_id, score_plugin): from the job's config, else a linked plugin of type score, else null."""
    linked = links.join(plugins.filter("type = 'score'"), "plugin_id").groupBy("job_id").agg(F.min("plugin_id").alias("linked"))
    named = F.get_json_object("config", "$.score_plugin").cast("long")
    return jobs.select("job_id", named.alias("named")).join(linked, "job_id", "left").select("job_id", F.coalesce("named", "linked").alias("score_plugin"))


def cache_split(requests: DataFrame, cache: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """requests with source: cache, store or remaining."""
    in_cache = cache.select(key).distinct().withColumn("_c", F.lit(True))
    in_store = store.select(key).distinct().withColumn("_s", F.lit(True))
    out = requests.join(in_cache, key, "left").join(in_store, key, "left")
    return out.withColumn("source", F.when(F.col("_c"), "cache").when(F.col("_s"), "store").otherwise("remaining")).drop("_c", "_s")


def reassemble(requests: DataFrame, unique: DataFrame, key: str, valid: str = "valid") -> DataFrame:
    """Results of unique requests for all that share a key; gaps are invalid."""
    return requests.join(unique, key, "left").withColumn(valid, F.coalesce(valid, F.lit(False)))


def pool_product(pools: list[DataFrame], keys: list[str]) -> DataFrame:
    """All combinations of one item of each pool within the keys (D9, D10): equi-joins, in order.

    The columns of the i-th pool that are not keys get the suffix _i.
    """
    named = [p.select(*keys, *(F.col(c).alias(f"{c}_{i}") for c in p.columns if c not in keys)) for i, p in enumerate(pools)]
    return reduce(lambda a, b: a.join(b, keys), named)


def best_products(pools: list[DataFrame], keys: list[str], m: int, score: str = "score", tie: str = "item_id") -> DataFrame:
    """The m best products of one item of each pool within the keys, by the sum of their scores, without the whole product.

    keys, the columns of the i-th pool with the suffix _i, total, place (from 1). Pools join one after the other, each ranked by
    score, ties by the tie column; products of equal totals stand by their place among those of the pools before, then by rank. A product of the
    i-th of the earlier products and the j-th of a pool has at least i * j - 1 before it, so pairs with i * j up to m are the
    frontier that can hold the best m: some m * log(m) a pool, met by an equal join on j, and of these the best m go on. Null scores and
    keys without an item in some pool give no product.
    """
    if m < 1:
        raise ValueError("m is 1 or more")
    ranked = []
    for i, pool in enumerate(pools):
        by = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
        held = pool.filter(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= m)
        ranked.append(held.select(*keys, *(F.col(c).alias(f"{c}_{i}") for c in pool.columns if c not in keys), F.col(score).cast("double").alias("_s"), "_r"))
    out = ranked[0].withColumnsRenamed({"_s": "total", "_r": "place"})
    for pool in ranked[1:]:
        sizes = pool.groupBy(*keys).agg(F.max("_r").alias("_n"))
        reach = F.least(F.floor(F.lit(m) / F.col("place")).cast("int"), F.col("_n"))
        frontier = out.join(sizes, keys).withColumn("_r", F.explode(F.sequence(F.lit(1), reach))).drop("_n")
        met = frontier.join(pool, [*keys, "_r"]).withColumn("total", F.col("total") + F.col("_s"))
        best = Window.partitionBy(*keys).orderBy(F.desc("total"), "place", "_r")
        out = met.withColumn("_p", F.row_number().over(best)).filter(F.col("_p") <= m).drop("place", "_r", "_s").withColumnRenamed("_p", "place")
    return out


def frontier_size(sizes: list[int], m: int) -> int:
    """The candidates that best_products() makes of pools of these sizes."""
    made, held = 0, min(sizes[0], m)
    for n in sizes[1:]:
        met = sum(min(m // i, n, m) for i in range(1, held + 1))
        made, held = made + met, min(met, m)
    return made


#: Fragments of a block: two blocks are a row of the last shuffle, so that an id is sent once for so many partners.
BLOCK = 2048
#: Fragments of a part of a block: two parts are one row until they are taken apart into pairs, which Spark holds for a row at a time.
PART = 64


def _fitting(left: DataFrame, right: DataFrame, rules: DataFrame) -> DataFrame:
    """(left, right): distinct sets of marks with a mark of one allowed beside a mark of the other; both tables hold marks."""
    a = left.select(F.col("marks").alias("left"), F.explode("marks").alias("left_mark"))
    b = right.select(F.col("marks").alias("right"), F.explode("marks").alias("right_mark"))
    return a.join(rules, "left_mark").join(b, "right_mark").select("left", "right").distinct()


def _parts(ids: str) -> Column:
    """A row for every PART of an array that is not empty, under its name."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.size(ids) - 1, F.lit(PART)), lambda i: F.slice(ids, i + 1, PART))).alias(ids)


def marked_pairs(fragments: DataFrame, rules: DataFrame) -> DataFrame:
    """(left_id, right_id): distinct pairs with a mark of one allowed beside a mark of the other.

    fragments: id, marks; rows of one id are one fragment. A fragment is known by the set of its marks that stand on
    a side of the rules, and sets meet sets. So a pair is made once, by however many marks it fits, and no pair is
    shuffled: a task takes apart rows of two blocks of some BLOCK ids each, dealt to all shuffle partitions.
    """
    partitions = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = fragments.filter("id is not null").select("id", F.explode("marks").alias("mark"))

    def side(name: str) -> tuple[DataFrame, DataFrame]:
        used = rules.select(F.col(f"{name}_mark").alias("mark")).distinct()
        kinds = marks.join(used, "mark", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("mark")).alias("marks"))
        sizes = kinds.groupBy("marks").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        numbered = kinds.join(sizes, "marks").select(F.col("marks").alias(name), F.expr("pmod(xxhash64(id), blocks)").cast("int").alias(f"{name}_block"), "id")
        return sizes, numbered.groupBy(name, f"{name}_block").agg(F.collect_list("id").alias(f"{name}_ids"))

    (left_sizes, left), (right_sizes, right) = side("left"), side("right")
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = _fitting(left_sizes, right_sizes, rules)
    for name, sizes in (("left", left_sizes), ("right", right_sizes)):
        met = met.join(sizes.withColumnRenamed("marks", name), name).withColumn(f"{name}_block", F.explode(numbers)).drop("blocks")
    keys = ["left", "left_block", "right", "right_block"]
    met = met.repartition(partitions, *keys)  # few rows as yet, which one task would join to all blocks
    dealt = met.join(left, keys[:2]).join(right, keys[2:]).repartition(partitions, *keys)
    parts = dealt.select(_parts("left_ids"), "right_ids").select("left_ids", _parts("right_ids"))
    # coalesce leaves the partitions as they are and ends the generated code, which could otherwise make all pairs of two blocks at once
    apart = parts.coalesce(partitions).select(F.explode("left_ids").alias("left_id"), "right_ids")
    return apart.select("left_id", F.explode("right_ids").alias("right_id")).filter("left_id <> right_id")


def marked_partner_counts(fragments: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, partners): for every fragment, how many right_id it has in marked_pairs(), without making the pairs.

    Fragments (ids are distinct) are counted by their set of marks, and sets meet sets. A set of partners
    counts once, by however many marks it fits; a fragment is no partner of its own.
    """
    kinds = fragments.select("id", F.array_sort(F.array_distinct(F.coalesce("marks", F.array().cast("array<string>")))).alias("marks"))
    counted = kinds.groupBy("marks").agg(F.count("*").alias("n"))
    fits = _fitting(counted, counted, rules).withColumnRenamed("right", "marks")
    own = F.when(F.col("left") == F.col("marks"), 1).otherwise(0)
    partners = fits.join(counted, "marks").groupBy("left").agg(F.sum(F.col("n") - own).alias("partners")).withColumnRenamed("left", "marks")
    return kinds.join(partners, "marks", "left").select("id", F.coalesce("partners", F.lit(0)).cast("long").alias("partners"))


def zero_filled_counts(rows: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """(kind, n) for every known kind, and the total."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    filled = kinds.join(counts, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(filled.agg(F.sum("n").alias("n")).select(F.lit("total").alias(kind), "n"))


def sum_or_zero(parents: DataFrame, children: DataFrame, key: str, value: str) -> DataFrame:
    """The sum of the children's value for every parent, 0 without children."""
    return parents.join(children.groupBy(key).agg(F.sum(value).alias(value)), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value in the row of highest order (E5)."""
    return rows.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, F.struct(order, value)).alias(value))


def component_check(assemblies: DataFrame, components: DataFrame) -> DataFrame:
    """assemblies (assembly_id, required) with n_components and complete; 0 if there is none."""
    counts = components.groupBy("assembly_id").agg(F.count("*").alias("n_components"))
    out = assemblies.join(counts, "assembly_id", "left").withColumn("n_components", F.coalesce("n_components", F.lit(0)))
    return out.withColumn("complete", F.col("n_components") == F.col("required"))


def sightings(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """How often each key was seen, and the first row's seq."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.min(seq).alias("first_seq"))


def components_array(rows: DataFrame, key: str, index: str, *columns: str) -> DataFrame:
    """Components of each key, in the order of their index."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("components"))


def nested_export(inputs: DataFrame, iterations: DataFrame, results: DataFrame) -> DataFrame:
    """input -> iterations -> results by score, nested, one row an input.

    inputs: input_id; iterations: input_id, iteration; results: input_id, iteration, item_id, score.
    """
    by_score = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("o"), "item_id", "score")
    inner = results.groupBy("input_id", "iteration").agg(F.array_sort(F.collect_list(by_score)).alias("results"))
    inner = iterations.join(inner, ["input_id", "iteration"], "left").withColumn("results", F.expr("transform(coalesce(results, array()), r -> struct(r.item_id as item_id, r.score as score))"))
    outer = inner.groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct("iteration", "results"))).alias("iterations"))
    return inputs.join(outer, "input_id", "left")


def execution_log(requests: DataFrame) -> DataFrame:
    """Counts by plugin of tagged requests (plugin_id, key, source, valid)."""
    of = lambda kind: F.count_distinct(F.when(F.col("source") == kind, F.col("key")))
    failed = F.count_distinct(F.when((F.col("source") == "remaining") & ~F.col("valid"), F.col("key")))
    return requests.groupBy("plugin_id").agg(F.count("*").alias("inputs"), F.count_distinct("key").alias("unique_inputs"), of("cache").alias("cache_hits"), of("store").alias("stored_hits"), of("remaining").alias("executed"), failed.alias("failed"))


def status_rollup(children: DataFrame, parent: str = "parent_id", status: str = "status") -> DataFrame:
    """Parents' status: null while a child is open, else with errors, early stop or complete."""
    s = F.col(status)
    rolled = (
        F.when(~F.bool_and(F.coalesce(s.isin(*TERMINAL), F.lit(False))), F.lit(None))
        .when(F.bool_or(s.isin("failed", "complete_with_errors")), "complete_with_errors")
        .when(F.bool_or(s == "early_stop"), "early_stop")
        .otherwise("complete")
    )
    return children.groupBy(parent).agg(rolled.alias("status"))


def invalid_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, problem): asked twice, or not known."""
    twice = asked.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("duplicate").alias("problem"))
    return twice.unionByName(asked.select(key).distinct().join(known.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem")))


def unreferenced(rows: DataFrame, key: str, references: list[Column | tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose key is in none of the tables (table, column): one anti-join to a union."""
    used = reduce(DataFrame.union, (t.select(F.col(c).alias(key)) for t, c in references))
    return rows.join(used.filter(F.col(key).isNotNull()), key, "left_anti")


def stale_assemblies(assemblies: DataFrame, components: DataFrame, results: DataFrame) -> DataFrame:
    """Assemblies that no result refers to, or with a wrong number of components."""
    wrong = component_check(assemblies, components).filter("not complete").select("assembly_id")
    loose = assemblies.join(results.filter("assembly_id is not null"), "assembly_id", "left_anti").select("assembly_id")
    return wrong.union(loose).distinct()


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What stays of each table (table, column) when the keys of gone are deleted."""
    ids = gone.select(key).distinct()
    return {name: t.join(ids.withColumnRenamed(key, "_gone"), F.col(c) == F.col("_gone"), "left_anti") for name, (t, c) in tables.items()}


def advantages(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(score - mean) / (population deviation + 1e-8) within the keys.

    Mean and deviation are aggregates, combined before the shuffle, so no task sees a whole key.
    """
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    stats = rows.groupBy(*(F.col(k).alias(n) for k, n in named.items())).agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_deviation"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()))
    return rows.join(stats, same).select(*rows.columns, ((F.col(score) - F.col("_mean")) / (F.col("_deviation") + 1e-8)).alias("advantage"))


def merged_sums(tables: list[DataFrame], key: str, *counters: str) -> DataFrame:
    """Counters of all tables added by key; null and null is null, null and x is x."""
    return reduce(DataFrame.unionByName, (t.select(key, *counters) for t in tables)).groupBy(key).agg(*(F.sum(c).alias(c) for c in counters))


def reference_counts(rows: DataFrame, key: str, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """key and, for each table (table, column), how many of its rows refer to it, 0 if none does."""
    out = rows.select(key)
    for name, (t, c) in references.items():
        out = out.join(t.groupBy(F.col(c).alias(key)).agg(F.count("*").alias(name)), key, "left")
    return out.na.fill(0, list(references))


def count_by_class(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of each class."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def unregistered(present: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are present but not registered (H1)."""
    return present.select(key).distinct().join(registered.select(key), key, "left_anti")


def distinct_pairs(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, each once, by position of the columns (H4)."""
    return reduce(DataFrame.union, tables).distinct()


def products_of(requests: DataFrame, assemblies: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Every request with valid and products: the known products of its parents, with their external ids.

    requests: request_id, key; assemblies: key, product_id; sources: product_id, external_id, of which a
    product may have none. A request of unknown parents has no products and is not valid.
    """
    known = assemblies.select(key, "product_id").join(sources.select("product_id", "external_id"), "product_id", "left")
    found = known.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("product_id", "external_id"))).alias("products"))
    none = F.array().cast(found.schema["products"].dataType)
    return requests.join(found, key, "left").withColumns({"valid": F.col("products").isNotNull(), "products": F.coalesce("products", none)})

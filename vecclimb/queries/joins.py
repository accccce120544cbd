"""Joins, counts, set operations and retention (D, E, H, N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecclimb.catalog import register
from vecclimb.operators import relations as R
from vecclimb.operators.bitmaps import PartnerIndex
from vecclimb.operators.windows import first_seen
from vecclimb.plans import jobs as C
from vecclimb.queries.standins import COMP, ITER, JOBS, PLUG, REQ, RES, components, item_results, items, iterations, jobs, plugins, requests
from vecclimb.queries.store import EXECUTED, _cached, _marked, executed
from vecclimb.session import Workspace, deal, table

# --- D: joins


@register("results_with_scores", f"with {RES} select doc_id, score, valid from documents left join res on item_id = doc_id")
def results_with_scores(spark, d):
    return R.with_scores(items(spark, d), item_results(spark, d), ["item_id"]).select(F.col("item_id").alias("doc_id"), "score", "valid")


@register("resolve_score_plugin", f"with {JOBS}, l as (select distinct l_orderkey as job_id, l_suppkey as plugin_id from lineitem), s as (select job_id, min(plugin_id) as linked from l where plugin_id % 3 = 0 group by 1) select job_id, coalesce(case when job_id % 4 = 0 then job_id % 100 end, linked) as score_plugin from jobs left join s using (job_id)")
def resolve_score_plugin(spark, d):
    config = F.when(F.col("job_id") % 4 == 0, F.to_json(F.struct((F.col("job_id") % 100).alias("score_plugin")))).otherwise(F.lit("{}"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("plugin_id")).distinct()
    kinds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plugin_id"), F.when(F.col("s_suppkey") % 3 == 0, "score").otherwise("filter").alias("type"))
    return R.resolved_score_plugin(jobs(spark, d).select("job_id", config.alias("config")), links, kinds)


@register("assemblies_by_component", f"with {COMP} select distinct item_id, assembly_id from comp")
def assemblies_by_component(spark, d):
    return components(spark, d).select("item_id", "assembly_id").distinct()


COMPKEY = f"{COMP}, k as (select assembly_id, string_agg(cast(item_id as varchar), '_' order by assembly_index) as key from comp group by 1)"


@register("assemblies_by_component_key", f"with {COMPKEY} select assembly_id, key from k where key in (select cast(p_partkey as varchar) from part)")
def assemblies_by_component_key(spark, d):
    keyed = R.components_array(components(spark, d), "assembly_id", "assembly_index", "item_id").select("assembly_id", F.array_join(F.transform("components", lambda c: c["item_id"].cast("string")), "_").alias("key"))
    wanted = plugins(spark, d).select(F.col("plugin_id").cast("string").alias("key"))
    return keyed.join(wanted, "key", "left_semi").select("assembly_id", "key")


@register("assemblies_by_product", f"with {COMP} select assembly_id, min(item_id) as product_id from comp group by 1 having min(item_id) % 2 = 1")
def assemblies_by_product(spark, d):
    return components(spark, d).groupBy("assembly_id").agg(F.min("item_id").alias("product_id")).filter("product_id % 2 = 1")


@register("lookup_item_results", f"with {REQ}, {RES} select event_id, req.item_id, score, valid from req left join res using (item_id)")
def lookup_item_results(spark, d):
    return R.with_scores(requests(spark, d), item_results(spark, d), ["item_id"]).select("event_id", "item_id", "score", "valid")


@register("lookup_assembly_results", f"with {COMPKEY}, r as (select p_partkey as request_id, cast(p_partkey as varchar) as key from part) select request_id, count(assembly_id) > 0 as valid, coalesce(string_agg(assembly_id || ':' || coalesce(cast(o_custkey as varchar), ''), ',' order by assembly_id), '') as products from r left join k using (key) left join orders on o_orderkey = assembly_id and o_orderkey % 3 > 0 group by 1")
def lookup_assembly_results(spark, d):
    keyed = R.components_array(components(spark, d), "assembly_id", "assembly_index", "item_id").select("assembly_id", F.array_join(F.transform("components", lambda c: c["item_id"].cast("string")), "_").alias("key"))
    asked = plugins(spark, d).select(F.col("plugin_id").alias("request_id"), F.col("plugin_id").cast("string").alias("key"))
    sources = table(spark, d, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").cast("string").alias("external_id"))
    out = R.products_of(asked, keyed.withColumnRenamed("assembly_id", "product_id"), sources, "key")
    named = F.transform("products", lambda p: F.concat(p["product_id"].cast("string"), F.lit(":"), F.coalesce(p["external_id"], F.lit(""))))
    return out.select("request_id", "valid", F.array_join(named, ",").alias("products"))


@register("iteration_results_join", f"with {ITER}, {JOBS}, {RES} select iter.job_id, iteration, inference, status, score from iter join jobs using (job_id) left join res on res.item_id = iter.job_id")
def iteration_results_join(spark, d):
    both = iterations(spark, d).join(jobs(spark, d), "job_id")
    scores = item_results(spark, d).withColumnRenamed("item_id", "job_id")
    return R.with_scores(both, scores, ["job_id"]).select("job_id", "iteration", "inference", "status", "score")


@register("mark_compatibility_join", "with m as (select p_partkey as id, unnest([upper(left(p_name, 1)) || ':' || p_size % 8, upper(left(p_type, 1)) || ':' || p_partkey % 5]) as mark from part), r as (select unnest(['S:1', 'B:2', 'R:3']) as lm, unnest(['P:1', 'L:2', 'M:3']) as rm) select distinct a.id as left_id, b.id as right_id from m a join r on a.mark = lm join m b on b.mark = rm where a.id <> b.id")
def mark_compatibility_join(spark, d):
    from vecclimb.functions.scalars import extract_marks

    fragments = _marked(spark, d).select("id", extract_marks(F.col("text")).alias("marks"))
    rules = spark.createDataFrame([("[S:1]", "[P:1]"), ("[B:2]", "[L:2]"), ("[R:3]", "[M:3]")], "left_mark string, right_mark string")
    return R.marked_pairs(fragments, rules)


@register("mark_compatibility_counts", "with m as (select p_partkey as id, unnest([upper(left(p_name, 1)) || ':' || p_size % 8, upper(left(p_type, 1)) || ':' || p_partkey % 5]) as mark from part), r as (select unnest(['S:1', 'B:2', 'R:3']) as lm, unnest(['P:1', 'L:2', 'M:3']) as rm), n as (select a.id, count(distinct b.id) as partners from m a join r on a.mark = lm join m b on b.mark = rm where a.id <> b.id group by 1) select p_partkey as id, coalesce(partners, 0) as partners from part left join n on n.id = p_partkey")
def mark_compatibility_counts(spark, d):
    from vecclimb.functions.scalars import extract_marks

    fragments = _marked(spark, d).select("id", extract_marks(F.col("text")).alias("marks"))
    rules = spark.createDataFrame([("[S:1]", "[P:1]"), ("[B:2]", "[L:2]"), ("[R:3]", "[M:3]")], "left_mark string, right_mark string")
    return R.marked_partner_counts(fragments, rules)


@register("mark_compatibility_page", "with m as (select p_partkey as id, unnest([upper(left(p_name, 1)) || ':' || p_size % 8, upper(left(p_type, 1)) || ':' || p_partkey % 5]) as mark from part), r as (select unnest(['S:1', 'B:2', 'R:3']) as lm, unnest(['P:1', 'L:2', 'M:3']) as rm), n as (select distinct a.id as left_id, b.id as right_id from m a join r on a.mark = lm join m b on b.mark = rm where a.id <> b.id) select left_id, right_id, place from (select *, row_number() over (partition by left_id order by right_id) as place from n) where place between 6 and 15")
def mark_compatibility_page(spark, d):
    """The second page of partners of every fragment, ten after the first five, from stored bitmaps."""
    return _partner_index(spark, d).page(5, 10)


@register("mark_compatibility_bitmap_counts", "with m as (select p_partkey as id, unnest([upper(left(p_name, 1)) || ':' || p_size % 8, upper(left(p_type, 1)) || ':' || p_partkey % 5]) as mark from part), r as (select unnest(['S:1', 'B:2', 'R:3']) as lm, unnest(['P:1', 'L:2', 'M:3']) as rm), n as (select a.id, count(distinct b.id) as partners from m a join r on a.mark = lm join m b on b.mark = rm where a.id <> b.id group by 1) select p_partkey as id, coalesce(partners, 0) as partners from part left join n on n.id = p_partkey")
def mark_compatibility_bitmap_counts(spark, d):
    return _partner_index(spark, d).counts()


def _partner_index(spark, d):
    from vecclimb.functions.scalars import extract_marks

    fragments = _marked(spark, d).select("id", extract_marks(F.col("text")).alias("marks"))
    rules = spark.createDataFrame([("[S:1]", "[P:1]"), ("[B:2]", "[L:2]"), ("[R:3]", "[M:3]")], "left_mark string, right_mark string")
    return PartnerIndex(fragments, rules, Workspace(spark, "partners").path)


@register("cache_split", f"with {EXECUTED} select event_id, source from ex")
def cache_split(spark, d):
    return R.cache_split(requests(spark, d), *_cached(spark, d), "key").select("event_id", "source")


@register("reassemble", f"with {REQ}, c as (select 'plugin:1:item:' || c_custkey as key, cast(c_nationkey as bigint) as value from customer) select event_id, c.value, c.value is not null as valid from req left join c using (key)")
def reassemble(spark, d):
    unique = _cached(spark, d)[0].select("key", F.col("value").cast("long").alias("value"), F.lit(True).alias("valid"))
    return R.reassemble(requests(spark, d).select("event_id", "key"), unique, "key").select("event_id", "value", "valid")


@register("linked_embeddings_count", "select l_suppkey as embedding_id, count(distinct l_partkey) as plugins from lineitem join part on p_partkey = l_partkey where p_type = 'SMALL' group by 1")
def linked_embeddings_count(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_partkey").alias("plugin_id"), F.col("l_suppkey").alias("embedding_id"))
    return bridge.join(plugins(spark, d).filter("kind = 'SMALL'"), "plugin_id").groupBy("embedding_id").agg(F.count_distinct("plugin_id").alias("plugins"))


BRIDGE = "b as (select distinct l_partkey as plugin_id, l_suppkey as embedding_id from lineitem)"


@register("embedding_delete_guard", f"with {PLUG}, {BRIDGE}, n as (select embedding_id, name from b join plug using (plugin_id) union select size as embedding_id, name from plug where kind = 'PROMO') select embedding_id, string_agg(distinct name, ',' order by name) as blockers from n group by 1")
def embedding_delete_guard(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_partkey").alias("plugin_id"), F.col("l_suppkey").alias("embedding_id")).distinct()
    records = plugins(spark, d)
    blockers = bridge.join(records, "plugin_id").select("embedding_id", "name").unionByName(records.filter("kind = 'PROMO'").select(F.col("size").alias("embedding_id"), "name"))
    return blockers.groupBy("embedding_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("blockers"))


@register("resolve_plugin_config", f"with {JOBS}, {PLUG}, {BRIDGE} select job_id, plugin_id, name, string_agg(cast(embedding_id as varchar), ',' order by embedding_id) as embeddings from jobs join plug on plug.plugin_id = jobs.job_id % 1000 left join b using (plugin_id) group by 1, 2, 3")
def resolve_plugin_config(spark, d):
    config = jobs(spark, d).select("job_id", (F.col("job_id") % 1000).alias("plugin_id"))
    bridge = table(spark, d, "lineitem").select(F.col("l_partkey").alias("plugin_id"), F.col("l_suppkey").alias("embedding_id")).distinct()
    linked = bridge.groupBy("plugin_id").agg(F.array_join(F.array_sort(F.collect_list("embedding_id")).cast("array<string>"), ",").alias("embeddings"))
    return config.join(plugins(spark, d), "plugin_id").join(linked, "plugin_id", "left").select("job_id", "plugin_id", "name", "embeddings")


@register("job_with_plugins", f"with {JOBS}, l as (select distinct l_orderkey as job_id, l_partkey as plugin_id from lineitem) select job_id, any_value(status) as status, count(plugin_id) as n_plugins, coalesce(string_agg(name, ',' order by plugin_id), '') as names from jobs left join l using (job_id) left join part on p_partkey = plugin_id left join (select p_partkey as pk, p_name as name from part) on pk = plugin_id group by 1")
def job_with_plugins(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("plugin_id")).distinct()
    named = links.join(plugins(spark, d).select("plugin_id", "name"), "plugin_id").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("plugin_id", "name"))).alias("p"))
    out = jobs(spark, d).select("job_id", "status").join(named, "job_id", "left")
    return out.select("job_id", "status", F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_plugins"), F.coalesce(F.array_join(F.transform("p", lambda x: x["name"]), ","), F.lit("")).alias("names"))


@register("seed_items", f"with {COMP} select assembly_id as input_id, assembly_index, item_id, p_name as item from comp join part on p_partkey = item_id")
def seed_items(spark, d):
    return components(spark, d).join(plugins(spark, d).select(F.col("plugin_id").alias("item_id"), F.col("name").alias("item")), "item_id").select(F.col("assembly_id").alias("input_id"), "assembly_index", "item_id", "item")


# --- E: aggregates


@register("plugin_summary", "with k as (select unnest(['SMALL', 'MEDIUM', 'LARGE', 'PROMO', 'ECONOMY', 'STANDARD', 'CUSTOM']) as kind), c as (select k.kind, count(p_partkey) as n from k left join part on p_type = k.kind group by 1) select kind, n from c union all select 'total', cast(sum(n) as bigint) from c")
def plugin_summary(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("SMALL", "MEDIUM", "LARGE", "PROMO", "ECONOMY", "STANDARD", "CUSTOM")], "kind string")
    return R.zero_filled_counts(plugins(spark, d), kinds, "kind")


@register("sum_inference_input", f"with {JOBS}, {ITER} select job_id, cast(coalesce(sum(inference), 0) as bigint) as inference from jobs left join iter using (job_id) group by 1")
def sum_inference_input(spark, d):
    return R.sum_or_zero(jobs(spark, d).select("job_id"), iterations(spark, d), "job_id", "inference")


@register("sum_inference_job", f"with {JOBS}, {ITER} select c_custkey as parent_id, cast(coalesce(sum(inference), 0) as bigint) as inference from customer left join jobs on parent_id = c_custkey left join iter using (job_id) group by 1")
def sum_inference_job(spark, d):
    inputs = R.sum_or_zero(jobs(spark, d).select("job_id", "parent_id"), iterations(spark, d), "job_id", "inference")
    return R.sum_or_zero(table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id")), inputs, "parent_id", "inference")


@register("count_results", f"with {RES} select source, count(*) as n, count(*) filter (where coalesce(valid, false)) as n_valid from documents left join res on item_id = doc_id group by 1")
def count_results(spark, d):
    rows = R.with_scores(items(spark, d), item_results(spark, d), ["item_id"])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.coalesce("valid", F.lit(False))).alias("n_valid"))


@register("latest_iteration", f"with {ITER} select job_id, max(iteration) as iteration, arg_max(inference, iteration) as inference from iter group by 1")
def latest_iteration(spark, d):
    return R.latest(iterations(spark, d), "job_id", "iteration", "inference")


REQUIRED = f"{COMP}, {JOBS}, req as (select job_id as assembly_id, 1 + job_id % 4 as required from jobs), cc as (select r.assembly_id, required, count(comp.item_id) as n_components from req r left join comp using (assembly_id) group by 1, 2)"


def _required(spark, d):
    return jobs(spark, d).select(F.col("job_id").alias("assembly_id"), (1 + F.col("job_id") % 4).alias("required"))


@register("component_count_check", f"with {REQUIRED} select assembly_id, required, n_components, n_components = required as complete from cc")
def component_count_check(spark, d):
    return R.component_check(_required(spark, d), components(spark, d)).select("assembly_id", "required", "n_components", "complete")


@register("duplicate_counts", f"with {REQ} select item_id, plugin_id, count(*) as count, min(event_id) as first_seq from req group by 1, 2")
def duplicate_counts(spark, d):
    return R.sightings(requests(spark, d), ["item_id", "plugin_id"], "event_id")


@register("components_array", f"with {COMP} select assembly_id, count(*) as n, string_agg(assembly_index || ':' || item_id, ',' order by assembly_index) as components from comp group by 1")
def components_array(spark, d):
    rows = R.components_array(components(spark, d), "assembly_id", "assembly_index", "item_id")
    return rows.select("assembly_id", F.size("components").cast("long").alias("n"), F.array_join(F.transform("components", lambda c: F.concat_ws(":", c["assembly_index"], c["item_id"])), ",").alias("components"))


@register("export_hierarchy", f"with {JOBS}, {ITER}, {COMP} select j.job_id as input_id, i.iteration, c.item_id, p_retailprice as score, row_number() over (partition by j.job_id, i.iteration order by p_retailprice desc, c.item_id) as place from jobs j join iter i using (job_id) join comp c on c.assembly_id = j.job_id and c.assembly_index = i.iteration join part on p_partkey = c.item_id")
def export_hierarchy(spark, d):
    rows = iterations(spark, d).withColumnRenamed("job_id", "input_id").select("input_id", "iteration")
    found = components(spark, d).join(plugins(spark, d).select(F.col("plugin_id").alias("item_id"), F.col("price").alias("score")), "item_id").select(F.col("assembly_id").alias("input_id"), F.col("assembly_index").alias("iteration"), "item_id", "score")
    nested = R.nested_export(jobs(spark, d).select(F.col("job_id").alias("input_id")), rows, found)
    flat = nested.select("input_id", F.inline("iterations")).select("input_id", "iteration", F.posexplode("results").alias("place", "r"))
    return flat.select("input_id", "iteration", "r.item_id", "r.score", (F.col("place") + 1).cast("long").alias("place"))


@register("merge_execute_stats", f"with {REQ} select plugin_id, cast(sum(case when event_type = 'error' then null else k end) as bigint) as executed, cast(sum(case when item_id % 2 = 0 then item_id end) as bigint) as cached from req group by 1")
def merge_execute_stats(spark, d):
    rows = requests(spark, d).select("plugin_id", F.when(F.col("event_type") != "error", F.col("k")).alias("executed"), F.when(F.col("item_id") % 2 == 0, F.col("item_id")).alias("cached"))
    return R.merged_sums([rows], "plugin_id", "executed", "cached")


@register("merge_key_counts", f"with {REQ} select key, count(*) as n from req group by 1")
def merge_key_counts(spark, d):
    rows = requests(spark, d).select("key", F.lit(1).cast("long").alias("n"), "event_type")
    return R.merged_sums([rows.filter("event_type = 'click'"), rows.filter("event_type <> 'click'")], "key", "n")


@register("execution_log", f"with {EXECUTED} select plugin_id, count(*) as inputs, count(distinct key) as unique_inputs, count(distinct key) filter (where source = 'cache') as cache_hits, count(distinct key) filter (where source = 'store') as stored_hits, count(distinct key) filter (where source = 'remaining') as executed, count(distinct key) filter (where source = 'remaining' and value is null) as failed from ex group by 1")
def execution_log(spark, d):
    return R.execution_log(executed(spark, d))


@register("inference_count", f"with {EXECUTED}, c as (select c_custkey % 8 as plugin_id from customer group by 1) select c.plugin_id, coalesce((select count(distinct key) from ex where source = 'remaining' and ex.plugin_id = c.plugin_id), 0) as inference from c")
def inference_count(spark, d):
    log = R.execution_log(executed(spark, d)).select("plugin_id", F.col("executed").alias("inference"))
    asked = table(spark, d, "customer").select((F.col("c_custkey") % 8).alias("plugin_id")).distinct()
    return asked.join(log, "plugin_id", "left").withColumn("inference", F.coalesce("inference", F.lit(0)))


@register("parent_status_rollup", f"with {JOBS}, s as (select parent_id % 97 as grp, parent_id, case when status = 'running' and parent_id % 3 = 0 then 'early_stop' when status = 'running' and parent_id % 3 = 1 then 'complete' when status = 'created' and parent_id % 5 = 0 then 'failed' when status = 'created' and parent_id % 5 < 4 then 'complete' else status end as st from jobs) select parent_id, case when not bool_and(st in ('complete', 'failed', 'early_stop')) then null when bool_or(st = 'failed') then 'complete_with_errors' when bool_or(st = 'early_stop') then 'early_stop' else 'complete' end as status from s group by 1")
def parent_status_rollup(spark, d):
    p, s = F.col("parent_id"), F.col("status")
    status = F.when((s == "running") & (p % 3 == 0), "early_stop").when((s == "running") & (p % 3 == 1), "complete").when((s == "created") & (p % 5 == 0), "failed").when((s == "created") & (p % 5 < 4), "complete").otherwise(s)
    return R.status_rollup(jobs(spark, d).select("parent_id", status.alias("status")))


@register("delete_preflight", f"with {PLUG}, {COMP}, {BRIDGE} select plugin_id, (select count(*) from b where b.plugin_id = plug.plugin_id) as jobs, (select count(*) from comp where item_id = plug.plugin_id) as assemblies from plug")
def delete_preflight(spark, d):
    bridge = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return R.reference_counts(plugins(spark, d), "plugin_id", {"jobs": (bridge, "l_partkey"), "assemblies": (components(spark, d), "item_id")})


@register("count_by_class", "select p_brand as grp, count(*) as n from part where p_name like 'red%' group by 1")
def count_by_class(spark, d):
    return plugins(spark, d).filter("name like 'red%'").transform(R.count_by_class, "grp")


@register("distinct_embedding_ids", "with a as (select l_partkey as id from lineitem) select id, 'duplicate' as problem from a group by 1 having count(*) > 1 union all select distinct id, 'unknown' from a where id not in (select s_suppkey from supplier)")
def distinct_embedding_ids(spark, d):
    asked = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))
    return R.invalid_ids(asked, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")


# --- H: set operations


@register("orphan_libraries", "select distinct label from embeddings except select n_nationkey % 7 from nation")
def orphan_libraries(spark, d):
    return R.unregistered(table(spark, d, "embeddings"), table(spark, d, "nation").select((F.col("n_nationkey") % 7).alias("label")), "label")


PAIRS = "p as (select a.p_name as l, b.p_name as r from part a join part b on b.p_partkey = a.p_partkey + 1)"


@register("union_products", f"with {PAIRS} select l || '+' || r as product from p union select r || '+' || l from p")
def union_products(spark, d):
    from vecclimb.plans.search import symmetric_assembly

    p = plugins(spark, d)
    pairs = p.select("plugin_id", F.col("name").alias("l")).join(p.select((F.col("plugin_id") - 1).alias("plugin_id"), F.col("name").alias("r")), "plugin_id")
    return symmetric_assembly(pairs, "l", "r", lambda a, b: F.concat_ws("+", a, b))


@register("union_sources", f"with {EXECUTED} select key, any_value(source) as source, any_value(value) as value from ex group by 1")
def union_sources(spark, d):
    return first_seen(executed(spark, d).select("key", "source", "value", "event_id"), ["key"], "event_id").select("key", "source", "value")


@register("job_plugin_ids", "select o_orderkey as job_id, o_orderkey % 1000 as plugin_id from orders union select l_orderkey, l_partkey from lineitem")
def job_plugin_ids(spark, d):
    config = jobs(spark, d).select("job_id", (F.col("job_id") % 1000).alias("plugin_id"))
    return R.distinct_pairs(config, table(spark, d, "lineitem").select("l_orderkey", "l_partkey"))


@register("invalid_ids", "select distinct user_id as id, 'unknown' as problem from events where user_id not in (select s_suppkey from supplier)")
def invalid_ids(spark, d):
    asked = requests(spark, d).select(F.col("item_id").alias("id")).distinct()
    return R.invalid_ids(asked, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")


# --- N: retention


@register("unreferenced_items", "select p_partkey as item_id from part where p_partkey not in (select s_suppkey from supplier) and p_partkey not in (select user_id from events) and p_partkey not in (select vec_id from embeddings)")
def unreferenced_items(spark, d):
    references = [(table(spark, d, t), c) for t, c in (("supplier", "s_suppkey"), ("events", "user_id"), ("embeddings", "vec_id"))]
    return R.unreferenced(table(spark, d, "part").select(F.col("p_partkey").alias("item_id")), "item_id", references)


@register("stale_assemblies", f"with {REQUIRED} select assembly_id from cc where n_components <> required union select assembly_id from req where assembly_id not in (select event_id from events where event_type <> 'error')")
def stale_assemblies(spark, d):
    results = requests(spark, d).filter("event_type <> 'error'").select(F.col("event_id").alias("assembly_id"))
    return R.stale_assemblies(_required(spark, d), components(spark, d), results)


@register("orphan_products", f"with {COMP} select p_partkey as item_id from part where p_type = 'PROMO' and p_partkey not in (select assembly_id from comp)")
def orphan_products(spark, d):
    sourced = plugins(spark, d).filter("kind = 'PROMO'").select(F.col("plugin_id").alias("item_id"))
    return sourced.join(components(spark, d).select(F.col("assembly_id").alias("item_id")), "item_id", "left_anti")


@register("unreferenced_jobs", "select o_orderkey as job_id from orders where o_orderkey not in (select l_orderkey from lineitem) and o_orderkey not in (select user_id from events) and o_orderkey not in (select c_custkey from customer)")
def unreferenced_jobs(spark, d):
    references = [(table(spark, d, t), c) for t, c in (("lineitem", "l_orderkey"), ("events", "user_id"), ("customer", "c_custkey"))]
    return R.unreferenced(jobs(spark, d).select("job_id"), "job_id", references)


@register("delete_by_component", f"with {COMP}, g as (select distinct assembly_id from comp where item_id % 50 = 3) select assembly_id, assembly_index, item_id from comp where assembly_id not in (select assembly_id from g)")
def delete_by_component(spark, d):
    rows = components(spark, d)
    return R.cascade_delete({"c": (rows, "assembly_id")}, rows.filter("item_id % 50 = 3"), "assembly_id")["c"].select("assembly_id", "assembly_index", "item_id")


@register("delete_job_cascade", f"with {JOBS}, {ITER}, g as (select job_id from jobs where status = 'complete' and price > 300000) select 'jobs' as name, count(*) as n from jobs where job_id not in (select * from g) union all select 'iterations', count(*) from iter where job_id not in (select * from g) union all select 'links', count(*) from (select distinct l_orderkey, l_suppkey from lineitem) where l_orderkey not in (select * from g)")
def delete_job_cascade(spark, d):
    rows = jobs(spark, d)
    links = deal(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey").distinct()
    left = R.cascade_delete({"jobs": (rows, "job_id"), "iterations": (iterations(spark, d), "job_id"), "links": (links, "l_orderkey")}, rows.filter("status = 'complete' and price > 300000"), "job_id")
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


STORE = f"""{COMP}, gone as (select o_orderkey as job_id from orders where o_orderstatus = 'F' and o_totalprice > 150000),
res as (select user_id as job_id, event_id % 2000 as item_id, case when event_id % 3 = 0 then null else event_id end as assembly_id from events),
asm as (select o_orderkey as assembly_id, o_custkey as product_id, 1 + o_orderkey % 4 as required from orders),
src as (select p_partkey as item_id, case when p_type in ('SMALL', 'PROMO') then 'assembly' else 'data_source' end as plugin_type from part where p_size > 10),
ir as (select doc_id as item_id from labels), it as (select p_partkey as item_id from part),
res2 as (select * from res where job_id not in (select * from gone)),
cnt as (select a.assembly_id, required, count(c.item_id) as n from asm a left join comp c using (assembly_id) group by 1, 2),
stale as (select assembly_id from cnt where n <> required union select assembly_id from asm where assembly_id not in (select assembly_id from res2 where assembly_id is not null)),
asm2 as (select * from asm where assembly_id not in (select * from stale)), comp2 as (select * from comp where assembly_id not in (select * from stale)),
orphan as (select distinct item_id from src where plugin_type = 'assembly' and item_id not in (select product_id from asm2)),
ir2 as (select * from ir where item_id not in (select * from orphan)), src2 as (select * from src where not (plugin_type = 'assembly' and item_id in (select * from orphan))),
it2 as (select * from it where item_id in (select item_id from src2 union select item_id from ir2 union select item_id from res2 union select item_id from comp2 union select product_id from asm2))"""


@register("delete_job_chain", f"with {STORE} select 'jobs' as name, count(*) as n from orders where o_orderkey not in (select * from gone) union all select 'links', count(*) from (select distinct l_orderkey, l_suppkey from lineitem) where l_orderkey not in (select * from gone) union all select 'results', count(*) from res2 union all select 'assemblies', count(*) from asm2 union all select 'components', count(*) from comp2 union all select 'sources', count(*) from src2 union all select 'item_results', count(*) from ir2 union all select 'items', count(*) from it2")
def delete_job_chain(spark, d):
    """Deleted jobs with what hung off them: assemblies, orphan products, their results and sources, unused items."""
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    store = {
        "jobs": o.select(F.col("o_orderkey").alias("job_id")),
        "links": deal(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_suppkey"), "job_id").distinct(),
        "results": e.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 2000).alias("item_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("assembly_id")),
        "assemblies": o.select(F.col("o_orderkey").alias("assembly_id"), F.col("o_custkey").alias("product_id"), (1 + F.col("o_orderkey") % 4).alias("required")),
        "components": components(spark, d),
        "sources": plugins(spark, d).filter("size > 10").select(F.col("plugin_id").alias("item_id"), F.when(F.col("kind").isin("SMALL", "PROMO"), "assembly").otherwise("data_source").alias("plugin_type")),
        "item_results": item_results(spark, d),
        "items": plugins(spark, d).select(F.col("plugin_id").alias("item_id")),
    }
    gone = o.filter("o_orderstatus = 'F' and o_totalprice > 150000").select(F.col("o_orderkey").alias("job_id"))
    left = C.delete_jobs(store, gone)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return reduce(DataFrame.unionByName, counts)


@register("seed_embedding_product", "with e as (select vec_id // 10 as input_id, vec_id % 2 as assembly_index, vec_id as embedding from embeddings) select a.input_id, a.embedding as embedding_0, b.embedding as embedding_1 from e a join e b using (input_id) where a.assembly_index = 0 and b.assembly_index = 1")
def seed_embedding_product(spark, d):
    """First queries of a job: a seed's embeddings at one position with those at the other."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("input_id"), (F.col("vec_id") % 2).alias("assembly_index"), F.col("vec_id").alias("embedding"))
    return R.pool_product([e.filter(F.col("assembly_index") == i).select("input_id", "embedding") for i in (0, 1)], ["input_id"])


@register("drop_library", "select vec_id as item_id from embeddings where label not in (select n_nationkey from nation where n_regionkey = 1)")
def drop_library(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("library_id"))
    gone = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("library_id"))
    return R.cascade_delete({"points": (rows, "library_id")}, gone, "library_id")["points"].select("item_id")


@register("delete_plugin_cascade", f"with {PLUG}, {COMP}, g as (select plugin_id from plug where kind = 'SMALL' and plugin_id not in (select item_id from comp)) select 'plugins' as name, count(*) as n from plug where plugin_id not in (select * from g) union all select 'results', count(*) from labels where doc_id not in (select * from g)")
def delete_plugin_cascade(spark, d):
    records = plugins(spark, d)
    gone = R.unreferenced(records.filter("kind = 'SMALL'").select("plugin_id"), "plugin_id", [(components(spark, d), "item_id")])
    left = R.cascade_delete({"plugins": (records, "plugin_id"), "results": (item_results(spark, d), "item_id")}, gone, "plugin_id")
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])

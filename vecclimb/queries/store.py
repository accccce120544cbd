"""Filters, scalar functions, first and last rows, pages, upserts and roles (B, F, G, I, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecclimb.catalog import register
from vecclimb.functions import scalars as J
from vecclimb.operators import filters as B
from vecclimb.operators import relations as R
from vecclimb.operators import roles
from vecclimb.operators import upserts as I
from vecclimb.operators import windows as W
from vecclimb.operators.buckets import upsert_bucketed, write_bucketed
from vecclimb.operators.pages import By, PagedTable
from vecclimb.queries.standins import COMP, JOBS, PLUG, REQ, RES, Q, components, item_results, items, jobs, plugins, requests
from vecclimb.session import Workspace, table

# --- B: filters and predicates


@register("filter_cascade", f"with {PLUG} select plugin_id, size >= 10 and price < 1500 and name not like '%ring%' as valid from plug")
def filter_cascade(spark, d):
    rows = plugins(spark, d).withColumn("valid", F.lit(True))
    return B.cascade(rows, [F.col("size") >= 10, F.col("price") < 1500, ~F.col("name").contains("ring")]).select("plugin_id", "valid")


@register("property_range_filter", f"with {PLUG} select plugin_id from plug where size between 5 and 30 and price >= 950")
def property_range_filter(spark, d):
    return plugins(spark, d).filter(B.in_ranges({"size": (5, 30), "price": (950, None)})).select("plugin_id")


CATALOGUE = ["(?i)password", "[0-9]{3}-[0-9]{4}", "@[a-z]+[.]"]


@register("catalog_filter", "select doc_id as item_id from documents where not (regexp_matches(text, '(?i)password') or regexp_matches(text, '[0-9]{3}-[0-9]{4}') or regexp_matches(text, '@[a-z]+[.]'))")
def catalog_filter(spark, d):
    return items(spark, d).filter(~B.matches_catalogue(F.col("item"), CATALOGUE)).select("item_id")


@register("pattern_count_filter", "select doc_id as item_id from documents where len(regexp_extract_all(text, 'th[a-z]')) between 2 and 40")
def pattern_count_filter(spark, d):
    return items(spark, d).filter(B.pattern_count_in(F.col("item"), "th[a-z]", 2, 40)).select("item_id")


@register("combined_filter", "select doc_id as item_id, coalesce(n_chars between 50 and 9000 and not regexp_matches(text, '(?i)password') and len(regexp_extract_all(text, '[$]')) <= 5, false) as valid from documents")
def combined_filter(spark, d):
    keep = B.combined(F.col("item"), {"n_chars": (50, 9000)}, CATALOGUE[:1], [("[$]", None, 5)])
    return items(spark, d).select("item_id", keep.alias("valid"))


CONFIG = "config as (select plugin_id % 200 as plugin_id, kind, name, case when size % 5 = 0 then null else size end as min, case when size % 10 = 0 then null else size + plugin_id % 7 - 2 end as max from plug), known as (select distinct name from plug where name not like 'small%')"


@register("normalise_filter_config", f"with {PLUG}, {CONFIG}, u as (select * from config where not (min is null and max is null) and coalesce(min <= max, true)), c as (select plugin_id, kind, name, count(*) as n from u group by 1, 2, 3) select plugin_id, kind, name, 'dropped' as problem from config where (min is null and max is null) or coalesce(min > max, false) union all select plugin_id, kind, name, 'duplicate' from c where n > 1 union all select plugin_id, kind, name, 'unknown' from c where name not in (select name from known) union all select plugin_id, kind, name, null from c where n = 1 and name in (select name from known) union all select distinct plugin_id, null, null, 'empty' from config where plugin_id not in (select plugin_id from u)")
def normalise_filter_config(spark, d):
    rows = plugins(spark, d)
    config = rows.select((F.col("plugin_id") % 200).alias("plugin_id"), "kind", "name", F.when(F.col("size") % 5 != 0, F.col("size")).alias("min"), F.when(F.col("size") % 10 != 0, F.col("size") + F.col("plugin_id") % 7 - 2).alias("max"))
    return B.normalised_config(config, rows.filter("name not like 'small%'").select("name").distinct())


@register("weighted_property_score", f"with {PLUG} select plugin_id, round(0.5 * size - 0.01 * price, 6) as score from plug")
def weighted_property_score(spark, d):
    return plugins(spark, d).select("plugin_id", F.round(B.weighted_score([("size", 0.5), ("price", -0.01)]), 6).alias("score"))


@register("record_filter", f"with {PLUG} select plugin_id from plug where name like '%bolt%' and kind in ('SMALL', 'PROMO') and grp = 'Brand#4'")
def record_filter(spark, d):
    return plugins(spark, d).filter(B.record_filter({"name": "%bolt%", "kind": ["SMALL", "PROMO"], "grp": "Brand#4", "size": None})).select("plugin_id")


@register("select_results", f"with {RES}, c as (select d.source as query_group, d.text as item, d.doc_id, res.score from documents d join res on res.item_id = d.doc_id where res.valid) select query_group, doc_id, score from (select *, row_number() over (partition by query_group, item order by score desc, doc_id desc) as n from c) where n = 1")
def select_results(spark, d):
    rows = items(spark, d).join(item_results(spark, d), "item_id").filter("valid").withColumnRenamed("source", "query_group")
    return W.last_wins(rows, ["query_group", "item"], F.desc("score"), F.desc("item_id")).select("query_group", F.col("item_id").alias("doc_id"), "score")


@register("apply_overrides", f"with {PLUG} select p.plugin_id, p.kind, coalesce(cast(s.s_acctbal as double), p.price) as price, p.size from plug p left join supplier s on s.s_suppkey = p.plugin_id")
def apply_overrides(spark, d):
    over = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plugin_id"), F.col("s_acctbal").alias("price"), F.lit(None).cast("long").alias("size"))
    return B.apply_overrides(plugins(spark, d), over, "plugin_id", ["price", "size"]).select("plugin_id", "kind", "price", "size")


@register("has_embedding", "select doc_id as item_id from documents where doc_id not in (select vec_id from embeddings)")
def has_embedding(spark, d):
    embedded = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"))
    return B.missing_embedding(items(spark, d), embedded, ["item_id"]).select("item_id")


@register("lookup_records", "select d.doc_id as item_id, d.lang, d.n_chars from documents d where d.doc_id in (select user_id from events)")
def lookup_records(spark, d):
    wanted = requests(spark, d).select("item_id")
    return B.lookup(items(spark, d), wanted, ["item_id"]).select("item_id", "lang", "n_chars")


# --- F, G: first and last rows, pages


@register("last_wins_dedup", f"with {REQ} select item_id, event_type, event_id, value from (select *, row_number() over (partition by item_id, event_type order by value desc, event_id desc) as n from req) where n = 1")
def last_wins_dedup(spark, d):
    return W.last_wins(requests(spark, d), ["item_id", "event_type"], F.desc("value"), F.desc("event_id")).select("item_id", "event_type", "event_id", "value")


@register("last_seen_in_batch", f"with {REQ} select key, max(event_id) as event_id, arg_max(value, event_id) as value from req group by key")
def last_seen_in_batch(spark, d):
    return W.last_seen(requests(spark, d).select("key", "event_id", "value"), ["key"], "event_id")


@register("top_result", f"with {JOBS} select parent_id, job_id, price from (select *, row_number() over (partition by parent_id order by price desc, job_id desc) as n from jobs) where n = 1")
def top_result(spark, d):
    return W.top_result(jobs(spark, d), ["parent_id"], "price", "job_id").select("parent_id", "job_id", "price")


@register("first_seen", f"with {REQ} select key, min(event_id) as event_id, arg_min(value, event_id) as value from req group by key")
def first_seen(spark, d):
    return W.first_seen(requests(spark, d).select("key", "event_id", "value"), ["key"], "event_id")


@register("results_page_by_score", f"with {RES} select doc_id, score from documents left join res on item_id = doc_id order by score desc nulls last, doc_id limit 100 offset 20")
def results_page_by_score(spark, d):
    rows = R.with_scores(items(spark, d), item_results(spark, d), ["item_id"])
    return W.page(rows.select(F.col("item_id").alias("doc_id"), "score"), F.desc_nulls_last("score"), F.col("doc_id"), offset=20, limit=100)


@register("results_page_by_time", f"with {JOBS} select job_id, day from jobs order by day, job_id limit 200 offset 100")
def results_page_by_time(spark, d):
    return W.page(jobs(spark, d).select("job_id", "day"), F.col("day"), F.col("job_id"), offset=100, limit=200)


@register("results_page_valid", f"with {RES} select item_id, score, (select count(*) from res where valid) as total from res where valid order by score desc, item_id limit 50 offset 10")
def results_page_valid(spark, d):
    return W.valid_page(item_results(spark, d), F.desc_nulls_last("score"), F.col("item_id"), offset=10, limit=50).select("item_id", "score", "total")


@register("jobs_page", f"with {JOBS} select job_id, status, day from jobs where status in ('created', 'running') and price > 100000 order by day desc, job_id desc limit 100 offset 50")
def jobs_page(spark, d):
    rows = jobs(spark, d).filter(B.record_filter({"status": ["created", "running"]}) & (F.col("price") > 100000))
    return W.page(rows.select("job_id", "status", "day"), F.desc("day"), F.desc("job_id"), offset=50, limit=100)


@register("plugins_page", f"with {PLUG} select plugin_id, name from plug where name like 'small%' order by plugin_id limit 40 offset 5")
def plugins_page(spark, d):
    return W.page(plugins(spark, d).filter(B.record_filter({"name": "small%"})).select("plugin_id", "name"), F.col("plugin_id"), offset=5, limit=40)


@register("results_deep_page", f"with {RES} select doc_id, score, row_number() over (order by score desc nulls last, doc_id) - 1 as place from documents left join res on item_id = doc_id order by place limit 100 offset (select count(*) // 2 from documents)")
def results_deep_page(spark, d):
    """A page from the middle of all results, of which only the ranges that hold it are sorted."""
    rows = R.with_scores(items(spark, d), item_results(spark, d), ["item_id"]).select(F.col("item_id").alias("doc_id"), "score")
    pages = PagedTable.build(rows, [By("score", descending=True), By("doc_id")], Workspace(spark, "pages").path, 2000)
    return pages.page(pages.total // 2, 100)


@register("results_after_cursor", f"with {JOBS}, o as (select job_id, day, row_number() over (order by day desc, job_id) - 1 as place from jobs) select job_id, day, place from o where day < 900000000 order by place limit 200")
def results_after_cursor(spark, d):
    """The page of jobs after a cursor, whose own row need not exist."""
    pages = PagedTable.build(jobs(spark, d).select("job_id", "day"), [By("day", descending=True), By("job_id")], Workspace(spark, "pages").path, 2000)
    return pages.after({"day": 900000000, "job_id": 2**62}, 200)


# --- I: upserts

SPLIT = "old as (select text as item, min(doc_id) as item_id from documents where doc_id % 3 = 0 group by text)"


def _old_items(spark, d):
    return items(spark, d).filter("item_id % 3 = 0").groupBy("item").agg(F.min("item_id").alias("item_id"))


@register("checkin_items", f"with {SPLIT} select d.doc_id, old.item_id as known_id, old.item_id is not null as known, count(*) over (partition by d.text) as copies from documents d left join old on old.item = d.text")
def checkin_items(spark, d):
    old = _old_items(spark, d)
    batch = items(spark, d).select(F.col("item_id").alias("doc_id"), "item")
    _, out = I.checkin_items(old.select("item_id", "item"), batch)
    known = old.select("item_id", F.lit(True).alias("known"))
    copies = out.groupBy("item_id").agg(F.count("*").alias("copies"))
    out = out.join(known, "item_id", "left").join(copies, "item_id")
    return out.select("doc_id", F.when(F.col("known"), F.col("item_id")).alias("known_id"), F.coalesce("known", F.lit(False)).alias("known"), "copies")


def _source_updates(spark, d):
    target = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.substring("p_brand", 7, 9).cast("long").alias("plugin_id"), J.external_id_text(F.col("p_size")).alias("external_id"))
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    updates = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), (F.col("l_suppkey") % 25 + 1).cast("long").alias("plugin_id"), J.external_id_text(seq).alias("external_id"), seq.alias("seq"))
    return target, updates


@register("upsert_item_sources", "with t as (select p_partkey as item_id, cast(substr(p_brand, 7) as bigint) as plugin_id, cast(p_size as varchar) as external_id from part), u as (select l_partkey as item_id, l_suppkey % 25 + 1 as plugin_id, max(l_orderkey * 10 + l_linenumber) as seq from lineitem group by 1, 2) select t.item_id, t.plugin_id, t.external_id from t where not exists (select 1 from u where u.item_id = t.item_id and u.plugin_id = t.plugin_id) union all select item_id, cast(plugin_id as bigint), cast(seq as varchar) from u")
def upsert_item_sources(spark, d):
    return I.merge_last(*_source_updates(spark, d), ["item_id", "plugin_id"])


@register("upsert_bucketed_sources", "with t as (select p_partkey as item_id, cast(substr(p_brand, 7) as bigint) as plugin_id, cast(p_size as varchar) as external_id from part), u as (select l_partkey as item_id, l_suppkey % 25 + 1 as plugin_id, max(l_orderkey * 10 + l_linenumber) as seq from lineitem group by 1, 2) select t.item_id, t.plugin_id, t.external_id from t where not exists (select 1 from u where u.item_id = t.item_id and u.plugin_id = t.plugin_id) union all select item_id, cast(plugin_id as bigint), cast(seq as varchar) from u")
def upsert_bucketed_sources(spark, d):
    """The same by tables in buckets of their keys: only the updates are shuffled."""
    target, updates = _source_updates(spark, d)
    work, keys = Workspace(spark, "sources"), ["item_id", "plugin_id"]
    names = [f"sources_{work.path[-12:]}_{v}" for v in (0, 1)]
    write_bucketed(target, names[0], keys, 8, f"{work.path}/0")
    return upsert_bucketed(names[0], updates, keys, 8, names[1], f"{work.path}/1")


@register("upsert_item_results", f"with {RES}, {REQ}, u as (select item_id, max(event_id) as event_id, arg_max(event_type <> 'error', event_id) as valid, arg_max(value, event_id) as score from req group by 1) select item_id, valid, score from res anti join u using (item_id) union all select item_id, valid, score from u")
def upsert_item_results(spark, d):
    updates = requests(spark, d).select("item_id", (F.col("event_type") != "error").alias("valid"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return I.merge_last(item_results(spark, d), updates, ["item_id"])


def _assembly_batch(spark, d, request=False):
    rows = components(spark, d).groupBy("assembly_id").agg(F.array_sort(F.collect_list(F.struct((F.col("assembly_index") - 1).alias("assembly_index"), "item_id"))).alias("components"))
    extra = [F.col("assembly_id").alias("request_id")] if request else []
    return rows.select(*extra, (F.col("assembly_id") % 500).alias("product_id"), "components")


KEYS = f"{COMP}, k as (select assembly_id % 500 as product_id, '7_' || string_agg(cast(item_id as varchar), '_' order by assembly_index) as component_key, count(*) as n from comp group by assembly_id)"


@register("checkin_assemblies", f"with {KEYS} select distinct component_key || '_' || product_id as assembly_key, component_key, product_id from k")
def checkin_assemblies(spark, d):
    batch = _assembly_batch(spark, d)
    first, _ = I.checkin_assemblies(spark.createDataFrame([], "assembly_id long, assembly_key string, component_key string, product_id long"), batch.filter("product_id < 250"), 7)
    merged, _ = I.checkin_assemblies(first, batch, 7)
    return merged.select("assembly_key", "component_key", "product_id")


@register("create_assembly", f"with {COMP} select assembly_id, min(assembly_index) = 1 and max(assembly_index) = count(*) as accepted from comp group by assembly_id")
def create_assembly(spark, d):
    i = F.col("assembly_index") - 1
    return components(spark, d).groupBy("assembly_id").agg(J.contiguous(F.min(i), F.max(i), F.count_distinct(i), F.count("*")).alias("accepted"))


@register("get_or_create_assembly", f"with {COMP}, b as (select assembly_id as request_id, assembly_id % 500 as product_id, string_agg(cast(item_id as varchar), '_' order by assembly_index) as p, min(assembly_index) = 1 and max(assembly_index) = count(*) as accepted from comp group by assembly_id) select request_id, accepted, case when accepted then count(*) over (partition by accepted, p, product_id) end as sharing from b")
def get_or_create_assembly(spark, d):
    """Requests for assemblies, half of them made before; how many requests got the same one."""
    batch = _assembly_batch(spark, d, request=True)
    none = spark.createDataFrame([], "assembly_id long, assembly_key string, component_key string, product_id long")
    old, _, _ = I.create_assembly(none, batch.filter("product_id < 250"), 7)
    _, _, out = I.create_assembly(old, batch, 7)
    shared = out.filter("accepted").groupBy("assembly_id").agg(F.count("*").alias("sharing"))
    return out.join(shared, "assembly_id", "left").select("request_id", "accepted", "sharing")


@register("relink_plugins", "with b as (select distinct l_partkey as plugin_id, l_suppkey as embedding_id from lineitem), w as (select s_suppkey as plugin_id, unnest([s_nationkey, s_nationkey + 1]) as embedding_id from supplier) select * from b where plugin_id not in (select plugin_id from w) union select plugin_id, embedding_id from w")
def relink_plugins(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("plugin_id"), F.col("l_suppkey").alias("embedding_id")).distinct()
    nation = F.col("s_nationkey").cast("long")
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plugin_id"), F.explode(F.array(nation, nation + 1)).alias("embedding_id"))
    return I.relink(links, wanted, "plugin_id")


@register("checkin_knn_sources", f"with {Q}, h as (select q.query_id, lib.external_id, row_number() over (partition by q.query_id order by list_cosine_similarity(q.vec, lib.vec) desc, lib.item_id) as rank, lib.label, lib.vec from q, lib), f as (select external_id, max(query_id) as last, any_value(label) as label, any_value(vec[1]) as first from h where rank <= 10 group by 1) select external_id, cast(last as varchar) as source, round(first, 6) as first from f")
def checkin_knn_sources(spark, d):
    """Items, sources and embeddings of what a search returns; the last query that found an item is its source's id."""
    from vecclimb.operators.knn import knn
    from vecclimb.queries.standins import asked, library

    lib = library(spark, d)
    hits = knn(asked(spark, d).drop("embedding_id"), lib).join(lib.select("item_id", "external_id", "label", "vec"), "item_id")
    hits = hits.select(F.col("external_id").alias("item"), F.col("query_id").cast("string").alias("external_id"), F.col("label").alias("embedding_id"), "vec", F.col("query_id").alias("seq"))
    none = lambda schema: spark.createDataFrame([], schema)
    found, sources, embedded = I.checkin_knn(none("item_id long, item string"), none("item_id long, plugin_id long, external_id string"), none("item_id long, embedding_id long, vec array<double>"), hits, 3)
    return found.join(sources, "item_id").join(embedded, "item_id").select(F.col("item").alias("external_id"), F.col("external_id").alias("source"), F.round(F.element_at("vec", 1), 6).alias("first"))


@register("checkin_assembly_outputs", f"with {KEYS} select component_key || '_' || product_id as assembly_key, cast(min(n) as bigint) as parents from k where product_id % 10 <> 0 group by 1")
def checkin_assembly_outputs(spark, d):
    outputs = _assembly_batch(spark, d).withColumn("valid", F.col("product_id") % 10 != 0)  # the others failed
    _, parents = I.checkin_assemblies(spark.createDataFrame([], "assembly_id long, assembly_key string, component_key string, product_id long"), outputs.filter("valid"), 7)
    keys, _ = I.checkin_assemblies(spark.createDataFrame([], "assembly_id long, assembly_key string, component_key string, product_id long"), outputs.filter("valid"), 7)
    return parents.groupBy("assembly_id").agg(F.count("*").alias("parents")).join(keys, "assembly_id").select("assembly_key", "parents")


@register("upsert_results", "with t as (select o_custkey as job_id, o_orderkey as item_id, case when o_orderkey % 4 = 0 then null else o_orderkey % 7 end as assembly_id, o_orderstatus = 'F' as valid from orders where o_orderkey % 3 < 2), u as (select o_custkey as job_id, o_orderkey as item_id, case when o_orderkey % 4 = 0 then null else o_orderkey % 7 end as assembly_id, o_orderstatus = 'O' as new_valid from orders where o_orderkey % 3 > 0) select coalesce(t.job_id, u.job_id) as job_id, coalesce(t.item_id, u.item_id) as item_id, coalesce(t.assembly_id, u.assembly_id) as assembly_id, coalesce(new_valid, valid) as valid, t.item_id is not null as old from t full join u on t.job_id = u.job_id and t.item_id = u.item_id and t.assembly_id is not distinct from u.assembly_id")
def upsert_results(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 7).alias("assembly_id"), "o_orderstatus", F.lit(0).alias("seq"))
    old = rows.filter("item_id % 3 < 2").select((-F.col("item_id") - 1).alias("result_id"), "job_id", "item_id", "assembly_id", (F.col("o_orderstatus") == "F").alias("valid"))
    new = rows.filter("item_id % 3 > 0").select("job_id", "item_id", "assembly_id", (F.col("o_orderstatus") == "O").alias("valid"), "seq")
    return I.upsert_results(old, new).select("job_id", "item_id", "assembly_id", "valid", (F.col("result_id") == -F.col("item_id") - 1).alias("old"))


@register("accumulate_iteration_counts", "select l_orderkey as result_id, cast(l_linenumber as bigint) as iteration_id, cast(sum(cast(l_quantity as bigint)) as bigint) as count from lineitem group by 1, 2")
def accumulate_iteration_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").cast("long").alias("iteration_id"), F.col("l_quantity").cast("long").alias("count"), "l_returnflag")
    return I.accumulate_counts(rows.filter("l_returnflag = 'A'").drop("l_returnflag"), rows.filter("l_returnflag <> 'A'").drop("l_returnflag"))


@register("link_job_plugins", "select distinct l_orderkey as job_id, l_suppkey as plugin_id from lineitem")
def link_job_plugins(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("plugin_id"), "l_linestatus")
    return I.link_pairs(rows.filter("l_linestatus = 'O'").drop("l_linestatus").distinct(), rows.filter("l_linestatus <> 'O'"))


@register("checkin_item_outputs", f"with {REQ} select item_id, arg_max(value, event_id) as score, max(event_id) as event_id from (select case when item_id % 10 = 0 then -1 else item_id end as item_id, value, event_id, event_type from req) where event_type <> 'error' and item_id <> -1 group by 1")
def checkin_item_outputs(spark, d):
    outputs = requests(spark, d).select(F.when(F.col("item_id") % 10 == 0, F.lit(-1)).otherwise(F.col("item_id")).cast("long").alias("item_id"), F.col("value").alias("score"), "event_id", (F.col("event_type") != "error").alias("executed"))
    return W.last_seen(I.stored_outputs(outputs).drop("executed"), ["item_id"], "event_id").select("item_id", "score", "event_id")


@register("checkin_knn_results", f"with {Q}, h as (select q.query_id, lib.external_id as item, row_number() over (partition by q.query_id order by list_cosine_similarity(q.vec, lib.vec) desc, lib.item_id) as rank from q, lib) select item, count(*) as sightings from h where rank <= 10 group by item")
def checkin_knn_results(spark, d):
    from vecclimb.operators.knn import knn
    from vecclimb.queries.standins import asked, library

    lib = library(spark, d)
    hits = knn(asked(spark, d).drop("embedding_id"), lib).join(lib.select("item_id", "external_id"), "item_id").select(F.col("external_id").alias("item"), "query_id", "rank")
    merged, out = I.checkin_items(spark.createDataFrame([], "item_id long, item string"), hits)
    return out.join(merged.select("item_id"), "item_id").groupBy("item").agg(F.count("*").alias("sightings"))


@register("update_records", f"with {PLUG}, u as (select s_suppkey as plugin_id, cast(s_nationkey - 5 as bigint) as size from supplier) select plug.plugin_id, plug.name, case when coalesce(u.size, plug.size) > 0 then coalesce(u.size, plug.size) else plug.size end as size, coalesce(u.size, plug.size) <= 0 as refused from plug left join u using (plugin_id)")
def update_records(spark, d):
    updates = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plugin_id"), (F.col("s_nationkey") - 5).cast("long").alias("size"), F.lit(None).cast("string").alias("name"))
    return I.update_records(plugins(spark, d), updates, "plugin_id", ["name", "size"], F.col("size") > 0)


@register("update_job_status", f"with {JOBS}, e as (select event_id as job_id, event_type from events), n as (select jobs.*, e.event_type, case e.event_type when 'error' then 'failed' when 'view' then 'cancelled' when 'click' then 'running' end as new from jobs left join e using (job_id)), m as (select *, new is not null and not (new = 'cancelled' and status = 'complete') as changed from n) select job_id, case when changed then new else status end as status, case when changed and new in ('failed', 'cancelled') then 1000 end as completed_at, case when changed then 1000 end as started_at from m")
def update_job_status(spark, d):
    updates = requests(spark, d).select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "cancelled").when(F.col("event_type") == "click", "running").alias("status"), F.lit(None).cast("string").alias("detail"))
    rows = jobs(spark, d).select("job_id", "status", F.lit(None).cast("string").alias("detail"), F.lit(None).cast("int").alias("started_at"), F.lit(None).cast("int").alias("completed_at"))
    return I.update_status(rows, updates, F.lit(1000)).select("job_id", "status", "completed_at", "started_at")


# --- J: scalar functions


@register("request_key", f"with {REQ} select event_id, key, 'plugin:' || plugin_id || ':assembly:' || item_id || '_' || k as assembly from req")
def request_key(spark, d):
    rows = requests(spark, d).drop("key")
    return rows.select("event_id", J.request_key(F.col("plugin_id"), "item", F.col("item_id")).alias("key"), J.request_key(F.col("plugin_id"), "assembly", F.concat_ws("_", "item_id", "k")).alias("assembly"))


@register("strip_key", f"with {REQ} select event_id, cast(item_id as varchar) as part from req")
def strip_key(spark, d):
    return requests(spark, d).select("event_id", J.strip_key(F.col("key"), "item").alias("part"))


@register("assembly_keys", f"with {KEYS} select component_key, component_key || '_' || product_id as assembly_key from k")
def assembly_keys(spark, d):
    rows = _assembly_batch(spark, d)
    return rows.select(J.component_key(F.lit(7), F.col("components")).alias("component_key"), J.assembly_key(F.lit(7), F.col("components"), F.col("product_id")).alias("assembly_key"))


MARKED = "m as (select p_partkey as id, '[' || upper(left(p_name, 1)) || ':' || p_size % 8 || ']x[' || upper(left(p_type, 1)) || ':' || p_partkey % 5 || ']' as text from part)"


def _marked(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.upper(F.substring("p_name", 1, 1)), F.lit(":"), (F.col("p_size") % 8).cast("string"), F.lit("]x["), F.upper(F.substring("p_type", 1, 1)), F.lit(":"), (F.col("p_partkey") % 5).cast("string"), F.lit("]")).alias("text"))


@register("extract_marks", f"with {MARKED} select id, array_to_string(case when r[1] = r[2] then r[1:1] else r end, ',') as marks from (select id, regexp_extract_all(text, '\\[[A-Za-z]+:\\d+\\]') as r from m)")
def extract_marks(spark, d):
    return _marked(spark, d).select("id", F.array_join(J.extract_marks(F.col("text")), ",").alias("marks"))


@register("count_parts", "select doc_id, cast(len(string_split(text, '.')) as bigint) as parts, cast(length(text) - length(replace(text, '*', '')) as bigint) as stars from documents")
def count_parts(spark, d):
    return items(spark, d).select(F.col("item_id").alias("doc_id"), J.count_parts(F.col("item")).cast("long").alias("parts"), J.count_of(F.col("item"), "*").cast("long").alias("stars"))


@register("concat_assembly", f"with {COMP} select assembly_id, string_agg(p_name, '' order by assembly_index) as product from comp join part on p_partkey = item_id group by assembly_id")
def concat_assembly(spark, d):
    names = plugins(spark, d).select(F.col("plugin_id").alias("item_id"), F.col("name").alias("item"))
    rows = components(spark, d).join(names, "item_id").groupBy("assembly_id").agg(F.collect_list(F.struct("assembly_index", "item")).alias("c"))
    return rows.select("assembly_id", J.concat_assembly(F.col("c")).alias("product"))


@register("over_limit", f"with {JOBS} select job_id, coalesce(price > case when job_id % 5 = 0 then null else 200000 end, false) as over from jobs")
def over_limit(spark, d):
    limit = F.when(F.col("job_id") % 5 != 0, F.lit(200000.0))
    return jobs(spark, d).select("job_id", J.over_limit(F.col("price"), limit).alias("over"))


@register("status_times", f"with {JOBS} select job_id, case when status <> 'created' then day end as started_at, case when status = 'complete' then day end as completed_at from jobs")
def status_times(spark, d):
    none = F.lit(None).cast("long")
    return jobs(spark, d).select("job_id", J.started_at(F.col("status"), none, F.col("day")).alias("started_at"), J.completed_at(F.col("status"), none, F.col("day")).alias("completed_at"))


@register("external_id_text", "select vec_id, cast(case when label = 3 then null else vec_id end as varchar) as external_id from embeddings")
def external_id_text(spark, d):
    return table(spark, d, "embeddings").select("vec_id", J.external_id_text(F.when(F.col("label") != 3, F.col("vec_id"))).alias("external_id"))


@register("contiguous_indices", "select l_orderkey as assembly_id, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) as contiguous from lineitem group by 1")
def contiguous_indices(spark, d):
    i = F.col("l_linenumber") - 1
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("assembly_id")).agg(J.contiguous(F.min(i), F.max(i), F.count_distinct(i), F.count("*")).alias("contiguous"))


@register("json_config_path", "select event_id, cast(props ->> '$.k' as bigint) as k, props ->> '$.missing' as missing from events")
def json_config_path(spark, d):
    return table(spark, d, "events").select("event_id", J.config_path(F.col("props"), "k").cast("long").alias("k"), J.config_path(F.col("props"), "missing").alias("missing"))


# --- K: roles


@register("role_embedding", "select doc_id as item_id, true as valid, round((length(lower(text)) - length(replace(lower(text), 'e', ''))) / greatest(1, length(text)), 6) as first from documents")
def role_embedding(spark, d):
    """Letter shares of an item's text as a vector, by a pandas function."""

    def shares(batch):
        return batch["item"].map(lambda t: [t.lower().count(c) / max(1, len(t)) for c in "etaoinsr"])

    plugin = roles.Plugin(1, "embedding", roles.from_pandas(shares, "array<double>"))
    rows = items(spark, d).select("item_id", "item")
    return plugin.build(rows).select("item_id", "valid", F.round(F.element_at("value", 1), 6).alias("first"))


@register("role_data_source", "select * from (select o_custkey as query_id, o_orderkey as item_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def role_data_source(spark, d):
    source = lambda rows: rows.join(jobs(spark, d).withColumnRenamed("parent_id", "query_id"), "query_id")  # noqa: E731 - a user's DataFrame -> DataFrame
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    from vecclimb.operators.knn import top_k

    return top_k(source(queries), ["query_id"], [F.desc("price"), F.col("job_id")], 3).select("query_id", F.col("job_id").alias("item_id"), F.col("rank").cast("long").alias("rank"))


@register("role_filter", f"with {PLUG} select plugin_id as item_id, size > 20 as valid from plug")
def role_filter(spark, d):
    plugin = roles.Plugin(2, "filter", roles.from_column(F.lit(1), F.col("size") > 20))
    return plugin.build(plugins(spark, d)).select(F.col("plugin_id").alias("item_id"), "valid")


@register("role_score", f"with {PLUG} select plugin_id as item_id, size % 7 <> 0 as valid, case when size % 7 <> 0 then round(price / size, 6) end as score from plug")
def role_score(spark, d):
    plugin = roles.Plugin(3, "score", roles.from_column(F.when(F.col("size") % 7 != 0, F.round(F.col("price") / F.col("size"), 6))))
    return plugin.build(plugins(spark, d)).select(F.col("plugin_id").alias("item_id"), "valid", F.col("value").alias("score"))


@register("role_mapper", "select vec_id as query_id, cast(g.i as bigint) as assembly_index, round((case when g.i = 0 then 0.5 else -1 end) * cast(embedding as double[])[1], 6) as first from embeddings, (select unnest([0, 1]) as i) g")
def role_mapper(spark, d):
    from vecclimb.functions.vectors import scale
    from vecclimb.queries.standins import library

    queries = library(spark, d).select(F.col("item_id").alias("query_id"), "vec")
    out = roles.mapped(queries, F.array(scale(F.col("vec"), F.lit(0.5)), scale(F.col("vec"), F.lit(-1.0))))
    return out.select("query_id", F.col("assembly_index").cast("long").alias("assembly_index"), F.round(F.element_at("vec", 1), 6).alias("first"))


@register("role_assembly", f"with {COMP}, s as (select assembly_id, string_agg(cast(item_id as varchar), '.' order by assembly_index) as p, count(*) as n from comp group by 1) select assembly_id, p as product from s where n > 1 union all select assembly_id, p || '!' from s where n > 3")
def role_assembly(spark, d):
    rows = components(spark, d).groupBy("assembly_id").agg(F.array_sort(F.collect_list(F.struct("assembly_index", "item_id"))).alias("parents"))
    p = F.array_join(F.transform("parents", lambda c: c["item_id"].cast("string")), ".")
    n = F.size("parents")
    products = F.when(n > 3, F.array(p, F.concat(p, F.lit("!")))).when(n > 1, F.array(p)).otherwise(F.array().cast("array<string>"))
    return roles.assembled(rows, products).select("assembly_id", "product")


VIOLATIONS = "pl as (select p_partkey as plugin_id, case p_type when 'SMALL' then 'embedding' when 'LARGE' then 'data_source' when 'PROMO' then 'mapper' when 'ECONOMY' then 'assembly' else 'score' end as type, p_size - 3 as batch_size, p_size % 9 - 1 as vector_length, case when p_partkey % 6 = 0 then 'Manhattan' when p_partkey % 6 = 1 then null else 'Cosine' end as metric, p_size % 4 as n from part)"


@register("validate_plugins", f"with {VIOLATIONS}, l as (select distinct l_partkey as plugin_id from lineitem) select plugin_id, 'limit' as problem from pl where batch_size <= 0 union all select plugin_id, 'vector_length' from pl where type = 'embedding' and vector_length <= 0 union all select plugin_id, 'metric' from pl where type = 'embedding' and (metric is null or metric = 'Manhattan') union all select plugin_id, 'no_embedding' from pl where type = 'data_source' and plugin_id not in (select plugin_id from l) union all select plugin_id, 'outputs' from pl where type = 'mapper' and n < 2 union all select plugin_id, 'parents' from pl where type = 'assembly' and n < 2")
def validate_plugins(spark, d):
    kinds = F.element_at(F.create_map(*(F.lit(x) for x in ("SMALL", "embedding", "LARGE", "data_source", "PROMO", "mapper", "ECONOMY", "assembly", "MEDIUM", "score", "STANDARD", "score"))), F.col("kind"))
    records = plugins(spark, d).select("plugin_id", kinds.alias("type"), (F.col("size") - 3).alias("batch_size"), (F.col("size") % 9 - 1).alias("vector_length"), F.when(F.col("plugin_id") % 6 == 0, "Manhattan").when(F.col("plugin_id") % 6 > 1, "Cosine").alias("metric"), (F.col("size") % 4).alias("n_outputs"), (F.col("size") % 4).alias("n_parents"))
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("plugin_id"), F.col("l_suppkey").alias("embedding_id")).distinct()
    return roles.violations(records, links)


CACHED = "cache as (select distinct 'plugin:1:item:' || c_custkey as key, cast(c_nationkey as double) as value from customer), store as (select distinct 'plugin:2:item:' || s_suppkey as key, cast(s_nationkey as double) as value from supplier)"


def _cached(spark, d):
    cache = table(spark, d, "customer").select(F.concat(F.lit("plugin:1:item:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_nationkey").cast("double").alias("value"))
    store = table(spark, d, "supplier").select(F.concat(F.lit("plugin:2:item:"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_nationkey").cast("double").alias("value"))
    return cache, store


def executed(spark, d):
    plugin = roles.Plugin(9, "score", roles.from_column(F.when(F.col("item_id") % 5 != 0, F.col("item_id") / 2)))
    return roles.execute_role(plugin, requests(spark, d).select("event_id", "plugin_id", "item_id", "key"), "key", *_cached(spark, d))


EXECUTED = f"{REQ}, {CACHED}, ex as (select event_id, plugin_id, item_id, key, case when c.value is not null then 'cache' when s.value is not null then 'store' else 'remaining' end as source, coalesce(c.value, s.value, case when item_id % 5 <> 0 then item_id / 2 end) as value from req left join cache c using (key) left join store s using (key))"


@register("execute_role", f"with {EXECUTED} select event_id, source, value, value is not null as valid from ex")
def execute_role(spark, d):
    return executed(spark, d).select("event_id", "source", "value", "valid")


@register("execute_role_stored", f"with {EXECUTED} select key, value from store union select key, value from ex where source = 'remaining' and value is not null")
def execute_role_stored(spark, d):
    """The store after a call of a role whose results are always stored."""
    return roles.stored_results(roles.Plugin(9, "score", None), executed(spark, d), _cached(spark, d)[1], "key")


@register("failure_to_invalid", f"with {PLUG} select plugin_id, size % 11 <> 0 as valid, case when size % 11 <> 0 then round(price * 2, 6) end as value, case when size % 11 = 0 then 'ValueError: size' end as error from plug")
def failure_to_invalid(spark, d):
    """A pandas function that raises for some rows: they become invalid, with the error."""

    def fragile(batch):
        if (batch["size"] % 11 == 0).any():
            raise ValueError("size")
        return batch["price"] * 2

    out = roles.from_pandas(fragile, "double", spread=True)(plugins(spark, d).select("plugin_id", "size", "price"))
    return out.select("plugin_id", "valid", F.round("value", 6).alias("value"), "error")

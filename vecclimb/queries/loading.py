"""Libraries, failures, jobs over time, and the rest of the search loop (A, L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecclimb.catalog import register
from vecclimb.operators import roles
from vecclimb.operators.windows import page
from vecclimb.plans import jobs as C
from vecclimb.plans import search as S
from vecclimb.queries.standins import JOBS, LIB, PLUG, REQ, RES, item_results, items, jobs, library, plugins, requests
from vecclimb.queries.store import CACHED, _cached
from vecclimb.session import Workspace, ship, table
from vecclimb.sources import library as A
from vecclimb.streaming import jobs as M
from vecclimb.streaming import state as K

# --- A: sources and sinks


@register("scan_library_csv", "select p_name as item, cast(p_partkey as varchar) as external_id from part")
def scan_library_csv(spark, d):
    work = Workspace(spark, "csv")
    plugins(spark, d).select(F.col("plugin_id").alias("external_id"), F.col("name").alias("item")).write.option("header", True).csv(f"{work.path}/library")
    return A.scan_library(spark, f"{work.path}/library")


@register("records_to_items", "select text as item, cast(doc_id as varchar) as external_id, true as valid from documents")
def records_to_items(spark, d):
    return A.records_to_items(items(spark, d).select("item", F.col("item_id").alias("external_id"))).select("item", "external_id", "valid")


def _embedded(spark, d):
    """documents as records; letter shares as embedding 1, lengths as embedding 2, which fails for short texts."""
    records = items(spark, d).select("item_id", "item", F.col("item_id").cast("string").alias("external_id"), F.lit(True).alias("valid"), "n_chars")
    n = F.col("n_chars").cast("double")
    share = lambda c: F.regexp_count("item", F.lit(c)) / n
    return A.embed_items(records, {1: F.when(n > 0, F.array(share("t"), share("e"), F.lit(1.0))), 2: F.when(n >= 200, F.array(n / 1000, F.lit(1.0)))})


EMB = "emb as (select doc_id as item_id, text, n_chars, [len(regexp_extract_all(text, 't')) / cast(n_chars as double), len(regexp_extract_all(text, 'e')) / cast(n_chars as double), 1.0] as v1, [n_chars / 1000.0, 1.0] as v2 from documents)"


@register("load_library", f"with {EMB}, e as (select item_id, cast(1 as bigint) as embedding_id, v1[1] as a, list_inner_product(v1, v1) as n2 from emb where n_chars > 0 union all select item_id, 2, v2[1], list_inner_product(v2, v2) from emb where n_chars >= 200) select item_id, embedding_id, round(sqrt(n2), 6) as norm, round(a / sqrt(n2), 6) as first from e")
def load_library(spark, d):
    work = Workspace(spark, "library")
    A.load_library(_embedded(spark, d), work.path, 1)
    points = spark.read.parquet(f"{work.path}/points")
    return points.select("item_id", F.col("embedding_id").cast("long").alias("embedding_id"), F.round("norm", 6).alias("norm"), F.round(F.element_at("vec", 1), 6).alias("first"))


@register("load_failures", "select cast(5 as bigint) as job_id, text as item, cast(doc_id as varchar) as external_id from documents where n_chars < 200")
def load_failures(spark, d):
    work = Workspace(spark, "library")
    A.load_library(_embedded(spark, d), work.path, 5)
    return spark.read.parquet(f"{work.path}/failures").select("job_id", "item", "external_id")


@register("load_summary", "select count(*) filter (where n_chars >= 200) as uploaded, count(*) filter (where n_chars < 200) as failed from documents")
def load_summary(spark, d):
    return A.load_summary(_embedded(spark, d))


@register("library_info", f"with {LIB} select embedding_id, count(*) as points, max(len(vec)) as vector_length, any_value(case n_regionkey % 2 when 0 then 'Cosine' else 'Euclid' end) as metric from lib left join nation on n_nationkey = embedding_id group by 1")
def library_info(spark, d):
    metric = F.when(F.col("n_regionkey") % 2 == 0, "Cosine").otherwise("Euclid")
    return A.library_info(library(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("embedding_id"), metric.alias("metric")))


@register("library_snapshot", f"with {LIB} select item_id, embedding_id, external_id, round(vec[64], 6) as last from lib")
def library_snapshot(spark, d):
    copy = A.snapshot(library(spark, d), Workspace(spark, "snapshots").path, "v1")
    return copy.select("item_id", "embedding_id", "external_id", F.round(F.element_at("vec", 64), 6).alias("last"))


@register("export_json", f"with {RES} select item_id, score, valid from res")
def export_json(spark, d):
    path = f"{Workspace(spark, 'export').path}/results"
    A.export_json(item_results(spark, d), path)
    return spark.read.schema("item_id long, score double, valid boolean").json(path)


@register("append_failures", f"with {PLUG} select 3 as job_id, 4 as plugin_id, 'execution' as reason, '{{\"plugin_id\":' || plugin_id || ',\"size\":' || size || '}}' as request from plug where size % 7 = 0")
def append_failures(spark, d):
    plugin = roles.Plugin(4, "score", roles.from_column(F.when(F.col("size") % 7 != 0, F.col("size"))))
    done = plugin.build(plugins(spark, d).select("plugin_id", "size").withColumn("source", F.lit("remaining")))
    path = f"{Workspace(spark, 'failures').path}/log"
    A.append_failures(roles.failures(done, plugin, 3).drop("detail"), path)
    return spark.read.parquet(path)


@register("failures_by_plugin", f"with {REQ} select event_id, item_id, asked_at from req where event_type = 'error' and plugin_id = 5 order by asked_at, event_id limit 100 offset 30")
def failures_by_plugin(spark, d):
    rows = requests(spark, d).filter("event_type = 'error' and plugin_id = 5").select("event_id", "item_id", "asked_at")
    return page(rows, F.col("asked_at"), F.col("event_id"), offset=30, limit=100)


# --- L: the rest of the search loop


@register("fan_out_source", "select o_orderkey as config_id, cast(unnest([0, 1, 2]) as bigint) as assembly_index from orders")
def fan_out_source(spark, d):
    config = jobs(spark, d).select(F.col("job_id").alias("config_id"))
    return S.fan_out(config, 3).withColumn("assembly_index", F.col("assembly_index").cast("long"))


@register("should_stop", "with s as (select o_orderkey as job_id, o_orderkey % 6 as iteration, o_totalprice as inference, case when o_custkey % 2 = 0 then null else 250000 end as lim, o_orderstatus <> 'P' as q, c_acctbal as parent, o_orderkey % 100 as age from orders join customer on c_custkey = o_custkey), e as (select *, iteration >= 4 as fin, coalesce(inference > lim, false) or parent > 9000 or age > 95 as early from s) select job_id, fin or not q or early as stop, case when fin and not early and q then 'complete' else 'early_stop' end as status from e")
def should_stop(spark, d):
    none = F.lit(None).cast("long")
    state = jobs(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id"), "c_acctbal"), "parent_id")
    start = F.timestamp_seconds(F.lit(1000))
    state = state.select("job_id", (F.col("job_id") % 6).alias("iteration"), F.lit(5).alias("max_iterations"), (F.col("status") != "running").alias("has_queries"), F.col("price").alias("inference"), F.when(F.col("parent_id") % 2 != 0, F.lit(250000)).alias("inference_limit"), F.timestamp_seconds(1000 - F.col("job_id") % 100).alias("started_at"), F.lit(95).alias("time_limit"), F.col("c_acctbal").alias("parent_inference"), F.lit(9000).alias("parent_inference_limit"), start.alias("parent_started_at"), none.alias("parent_time_limit"))
    return S.should_stop(state, start).select("job_id", "stop", "status")


@register("create_job", f"with {PLUG}, s as (select l_orderkey as input_id, l_linenumber - 1 as i, min(l_partkey) as plugin_id from lineitem group by 1, 2), c as (select input_id, count(*) as n from s group by 1) select input_id, 'parent_count' as problem from c where n <> 3 union all select input_id, 'plugin_type' from (select distinct input_id from s join plug using (plugin_id) where kind = 'ECONOMY')")
def create_job(spark, d):
    """Problems of inputs: other than three parents, or a parent of a type that cannot be one."""
    seeds = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("input_id"), (F.col("l_linenumber") - 1).alias("assembly_index")).agg(F.min("l_partkey").alias("plugin_id"))
    count = seeds.groupBy("input_id").agg(F.count("*").alias("n")).filter("n <> 3").select("input_id", F.lit("parent_count").alias("problem"))
    wrong = seeds.join(plugins(spark, d).filter("kind = 'ECONOMY'"), "plugin_id", "left_semi").select("input_id", F.lit("plugin_type").alias("problem")).distinct()
    return count.unionByName(wrong)


@register("create_job_inputs", f"with {PLUG}, s as (select l_orderkey as job_id, l_suppkey as input_no, l_linenumber as i, p_name as item, case when l_quantity > 40 then cast(l_quantity as bigint) end as own from lineitem join part on p_partkey = l_partkey), n as (select job_id, input_no, count(*) as n_seeds, max(own) as own, count(distinct item) as items from s group by 1, 2) select job_id, input_no, n_seeds, coalesce(own, 10) as inference_limit, cast(5 as bigint) as max_iterations, o_orderkey % 60 as time_limit, items from n join orders on o_orderkey = job_id")
def create_job_inputs(spark, d):
    """Orders as jobs, their lines as seeds; a supplier is an input, and large quantities are limits of its own."""
    jobs_ = jobs(spark, d).select("job_id", F.lit(5).cast("long").alias("max_iterations"), F.lit(10).cast("long").alias("inference_limit"), (F.col("job_id") % 60).alias("time_limit"))
    none = F.lit(None).cast("long")
    own = F.when(F.col("l_quantity") > 40, F.col("l_quantity").cast("long"))
    parts = plugins(spark, d).select(F.col("plugin_id").alias("l_partkey"), F.col("name").alias("item"))
    seeds = table(spark, d, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("input_no"), F.col("l_linenumber").alias("assembly_index"), "item", F.col("l_partkey").cast("string").alias("external_id"), own.alias("inference_limit"), none.alias("max_iterations"), none.alias("time_limit"))
    old = parts.filter("l_partkey % 2 = 0").select("item", F.col("l_partkey").alias("item_id")).groupBy("item").agg(F.min("item_id").alias("item_id")).select("item_id", "item")
    inputs, _, checked = C.create_inputs(jobs_, seeds, old)
    different = checked.groupBy("job_id", "input_no").agg(F.count_distinct("item_id").alias("items"))
    return inputs.join(different, ["job_id", "input_no"])


@register("job_config_violations", """with kinds as (select p_partkey as plugin_id, case p_type when 'SMALL' then 'embedding' when 'LARGE' then 'data_source' when 'PROMO' then 'mapper' when 'ECONOMY' then 'assembly' when 'MEDIUM' then 'score' else 'filter' end as type, p_size % 3 + 1 as n_parents from part where p_partkey % 50 <> 0),
c as (select distinct l_orderkey as job_id, l_partkey as plugin_id, cast(l_linenumber - 1 as int) as assembly_index, case l_linenumber % 4 when 0 then 'mapper' when 1 then 'assembly' else 'data_source' end as role from lineitem),
n as (select job_id, count(*) filter (where role = 'data_source') as n from c group by 1),
outs as (select plugin_id, unnest([1, 2]) as assembly_index, plugin_id % 3 as embedding_id from kinds),
links as (select plugin_id, plugin_id % 3 as embedding_id from kinds),
k as (select c.*, type, n_parents from c left join kinds using (plugin_id))
select job_id, 'unknown' as problem, plugin_id from k where type is null
union select job_id, 'type', plugin_id from k where type <> role
union select job_id, 'parents', plugin_id from k join n using (job_id) where role = 'assembly' and type is not null and n <> n_parents
union select job_id, 'outputs', plugin_id from k join n using (job_id) where role = 'mapper' and n <> case when type is null then 0 else 2 end
union select m.job_id, 'embedding', s.plugin_id from c m join outs o on o.plugin_id = m.plugin_id join c s on s.job_id = m.job_id and s.role = 'data_source' and s.assembly_index = o.assembly_index where m.role = 'mapper' and not exists (select 1 from links l where l.plugin_id = s.plugin_id and l.embedding_id = o.embedding_id)""")
def job_config_violations(spark, d):
    """Order lines as the plugins of a job, in roles by line; parts are plugins of the types that their kinds name."""
    types = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("SMALL", "embedding", "LARGE", "data_source", "PROMO", "mapper", "ECONOMY", "assembly", "MEDIUM", "score"))), F.col("kind")), F.lit("filter"))
    known = plugins(spark, d).filter("plugin_id % 50 <> 0").select("plugin_id", types.alias("type"), (F.col("size") % 3 + 1).alias("n_parents"))
    line = F.col("l_linenumber")
    role = F.when(line % 4 == 0, "mapper").when(line % 4 == 1, "assembly").otherwise("data_source")
    config = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("plugin_id"), (line - 1).cast("int").alias("assembly_index"), role.alias("role")).distinct()
    embedding = (F.col("plugin_id") % 3).alias("embedding_id")
    outputs = known.select("plugin_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("assembly_index"), embedding)
    return C.config_violations(config, known.select("plugin_id", "type", "n_parents"), outputs, known.select("plugin_id", embedding))


@register("explore_exploit", f"with {RES} select * from (select item_id, 'best' as origin from res order by score desc, item_id limit 40) union all select * from (select vec_id as item_id, 'fresh' as origin from embeddings where vec_id not in (select item_id from res) order by vec_id limit 60)")
def explore_exploit(spark, d):
    results = item_results(spark, d)
    seeds = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("vec_id").alias("seed_no"))
    return S.explore_exploit(results, seeds, results.select("item_id"), 100, 0.6)


STAGED = "first as (select distinct p_name as p from part where p_size <= 10), a as (select distinct p_name as part from part where p_size > 10 and p_type = 'SMALL'), b as (select distinct p_name as part from part where p_type = 'LARGE'), one as (select distinct p || '-' || part as p from first join a on p like '%ring' and part like 'red%' or p like '%bolt' and part like 'blue%'), two as (select distinct p || '=' || part as p from one join b on p like '%gear' and part like 'hot%')"


@register("staged_assembly", f"with {STAGED} select p as product from two")
def staged_assembly(spark, d):
    p = plugins(spark, d)
    first = p.filter("size <= 10").select(F.col("name").alias("product"))
    parents = p.filter("size > 10 and kind = 'SMALL'").select(F.lit(0).alias("stage"), F.col("name").alias("part")).unionByName(p.filter("kind = 'LARGE'").select(F.lit(1).alias("stage"), F.col("name").alias("part")))
    rules = spark.createDataFrame([(0, "ring", "red", "-"), (0, "bolt", "blue", "-"), (1, "gear", "hot", "=")], "stage int, left string, right string, sep string")
    return S.staged_assembly(first, parents, rules, 2)


@register("symmetric_assembly", "with p as (select o_orderpriority as l, c_mktsegment as r from orders join customer on c_custkey = o_custkey) select l || '.' || r as product from p union select r || '.' || l from p")
def symmetric_assembly(spark, d):
    pairs = jobs(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id"), "c_mktsegment"), "parent_id")
    return S.symmetric_assembly(pairs, "priority", "c_mktsegment", lambda a, b: F.concat_ws(".", a, b))


# --- M: work over time


@register("pending_jobs", f"with {JOBS} select job_id, 'queued' as status from jobs where job_id > 500 and status = 'created' and priority = '1-URGENT'")
def pending_jobs(spark, d):
    rows = jobs(spark, d).withColumn("auto_run", F.col("priority") == "1-URGENT")
    return M.pending(rows, 500).select("job_id", "status")


@register("run_key_dedup", "select user_id as job_id, count(*) as asked from events group by 1")
def run_key_dedup(spark, d):
    asked = requests(spark, d).select(F.col("item_id").alias("job_id"))
    runs = asked.dropDuplicates(["job_id"])
    return runs.join(asked.groupBy("job_id").agg(F.count("*").alias("asked")), "job_id")


@register("result_cache_ttl", f"with {REQ} select event_id, key, value from req where event_type <> 'error' and 1706000000 - asked_at <= 604800")
def result_cache_ttl(spark, d):
    rows = requests(spark, d).select("event_id", "key", "value", (F.col("event_type") != "error").alias("valid"), F.timestamp_seconds("asked_at").alias("created_at"))
    return M.alive(rows, F.timestamp_seconds(F.lit(1706000000)), 604800).select("event_id", "key", "value")


@register("clear_cache", f"with {CACHED} select key, value from (select * from cache union all select * from store) where key not like 'plugin:1:%'")
def clear_cache(spark, d):
    cache, store = _cached(spark, d)
    return M.cleared(cache.unionByName(store), 1)


@register("failed_runs", f"with {JOBS}, e as (select event_id, user_id as job_id, ts, case event_type when 'error' then 'FAILURE' when 'view' then 'CANCELED' end as st from events where event_type in ('error', 'view')), l as (select job_id, arg_max(st, (ts, event_id)) as st from e group by 1) select job_id, case st when 'FAILURE' then 'failed' else 'cancelled' end as status from jobs join l using (job_id)")
def failed_runs(spark, d):
    e = table(spark, d, "events").filter("event_type in ('error', 'view')")
    runs = e.select("event_id", F.col("user_id").alias("job_id"), "ts", F.when(F.col("event_type") == "error", "FAILURE").otherwise("CANCELED").alias("run_status"))
    return M.failed_jobs(runs, jobs(spark, d))


@register("stream_library_load", "select p_name as item, cast(p_partkey as varchar) as external_id, cast(length(p_name) as bigint) as chars from part")
def stream_library_load(spark, d):
    """Library records written as CSV, taken up by a stream until none is left, and read back."""
    path = Workspace(spark, "stream").path
    plugins(spark, d).select(F.col("plugin_id").alias("external_id"), F.col("name").alias("item")).write.option("header", True).csv(f"{path}/in")
    embed = lambda rows: rows.select("item", "external_id", F.length("item").cast("long").alias("chars"))
    M.stream_library(spark, f"{path}/in", f"{path}/out", f"{path}/state", embed).awaitTermination()
    return spark.read.parquet(f"{path}/out")


# --- M: keyed state


def _streamed(spark, rows, process):
    """What a processor gives of a table that a stream reads from files."""
    path, setting = Workspace(spark, "stream").path, "spark.sql.streaming.stateStore.providerClass"
    ship(spark)
    rows.write.parquet(f"{path}/in")
    before = spark.conf.get(setting)
    K.use_store(spark)
    try:
        query = process(spark.readStream.schema(rows.schema).parquet(f"{path}/in")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{path}/out")


def _timed(spark, d):
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), at.alias("at"), "event_type", "value")


YEARS = 20 * 365 * 86_400


@register("stream_runs_once", "select cast(user_id as varchar) as key, cast(epoch_us(min(ts)) as bigint) as at from events group by 1")
def stream_runs_once(spark, d):
    """Users as run keys: each once, at its first event."""
    found = _streamed(spark, _timed(spark, d).select("key", "at"), lambda s: K.runs_once(s, YEARS))
    return found.select("key", F.unix_micros("at").alias("at"))


@register("stream_cached_results", """with r as (select cast(user_id as varchar) as key, epoch_ms(ts) as ms, epoch_us(ts) as us, event_type = 'view' as request, case when event_type <> 'error' then value end as value from events where event_type in ('view', 'purchase', 'error')),
w as (select *, last_value(case when not request then value end ignore nulls) over o as held, last_value(case when not request and value is not null then ms end ignore nulls) over o as since from r window o as (partition by key order by us, request, value is null, coalesce(value, 0) rows unbounded preceding))
select key, cast(us as bigint) as at, case when ms - since <= 604800000 then held end as value, case when ms - since <= 604800000 then 'cache' else 'execute' end as source from w where request""")
def stream_cached_results(spark, d):
    """Views as requests, purchases as results and errors as failed ones: a result answers for a week."""
    kind = F.when(F.col("event_type") == "view", "request").otherwise("result")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    rows = _timed(spark, d).filter("event_type in ('view', 'purchase', 'error')").select("key", "at", kind.alias("kind"), value.alias("value"))
    found = _streamed(spark, rows, lambda s: K.cached_results(s, 604_800))
    return found.select("key", F.unix_micros("at").alias("at"), "value", "source")


@register("stream_run_statuses", """with e as (select cast(user_id as varchar) as key, epoch_us(ts) as us, case event_type when 'click' then 'STARTED' when 'purchase' then 'SUCCESS' when 'error' then 'FAILURE' when 'view' then 'CANCELED' end as event from events where event_type <> 'signup'),
k as (select *, coalesce(max(event <> 'STARTED') over (partition by key order by us, event rows between unbounded preceding and 1 preceding), false) as over_ from e),
c as (select *, lag(event) over (partition by key order by us, event) as before from k where not (over_ and event = 'STARTED'))
select key, cast(us as bigint) as at, case event when 'STARTED' then 'running' when 'SUCCESS' then 'complete' when 'FAILURE' then 'failed' else 'cancelled' end as status from c where before is distinct from event""")
def stream_run_statuses(spark, d):
    """Events as those of runs: clicks start, purchases end well, errors fail, views cancel."""
    names = F.create_map(*(F.lit(x) for x in ("click", "STARTED", "purchase", "SUCCESS", "error", "FAILURE", "view", "CANCELED", "signup", "OTHER")))
    rows = _timed(spark, d).select("key", "at", F.element_at(names, F.col("event_type")).alias("event"))
    return _streamed(spark, rows, lambda s: K.run_statuses(s, YEARS)).select("key", F.unix_micros("at").alias("at"), "status")

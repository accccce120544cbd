"""How the given tables play the parts of the engine's own, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecclimb.session import deal, table


def library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 2).cast("long").alias("embedding_id"), F.col("label").cast("long").alias("label"), F.col("vec_id").cast("string").alias("external_id"), F.col("embedding").cast("array<double>").alias("vec"))


LIB = "lib as (select vec_id as item_id, cast(label % 2 as bigint) as embedding_id, cast(label as bigint) as label, cast(vec_id as varchar) as external_id, cast(embedding as double[]) as vec from embeddings)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return library(spark, d).filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding_id", "vec")


Q = LIB + ", q as (select item_id as query_id, embedding_id, vec from lib where item_id % 100 = 0)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("item"), "source", "lang", "n_chars")


def item_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("toxic") == 0).alias("valid"), F.col("quality").cast("double").alias("score"))


RES = "res as (select doc_id as item_id, toxic = 0 as valid, cast(quality as double) as score from labels)"


def plugins(spark: SparkSession, d: str) -> DataFrame:
    """part as plugin records; types by p_type."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("plugin_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("grp"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"))


PLUG = "plug as (select p_partkey as plugin_id, p_name as name, p_type as kind, p_brand as grp, cast(p_size as bigint) as size, p_retailprice as price from part)"


def components(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as parents of assemblies: the part at each line, the least of repeated lines."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("assembly_id"), F.col("l_linenumber").cast("long").alias("assembly_index"), F.col("l_partkey").alias("item_id"))
    return deal(rows, "assembly_id").groupBy("assembly_id", "assembly_index").agg(F.min("item_id").alias("item_id"))


COMP = "comp as (select l_orderkey as assembly_id, cast(l_linenumber as bigint) as assembly_index, min(l_partkey) as item_id from lineitem group by 1, 2)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """orders as jobs of customers."""
    status = F.element_at(F.create_map(*(F.lit(x) for x in ("O", "created", "P", "running", "F", "complete"))), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("parent_id"), status.alias("status"), F.col("o_totalprice").alias("price"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("day"), F.col("o_orderpriority").alias("priority"))


JOBS = "jobs as (select o_orderkey as job_id, o_custkey as parent_id, case o_orderstatus when 'O' then 'created' when 'P' then 'running' else 'complete' end as status, o_totalprice as price, cast(epoch(o_orderdate) as bigint) as day, o_orderpriority as priority from orders)"


def iterations(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as iterations of a job; quantities are inference counts."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("iteration"), F.col("l_quantity").cast("long").alias("inference"))
    return rows.groupBy("job_id", "iteration").agg(F.sum("inference").alias("inference"))


ITER = "iter as (select l_orderkey as job_id, cast(l_linenumber as bigint) as iteration, cast(sum(cast(l_quantity as bigint)) as bigint) as inference from lineitem group by 1, 2)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """events as requests of plugins: a plugin by type, an item by user, k of props as answer."""
    e = table(spark, d, "events")
    plugin = F.element_at(F.create_map(*(F.lit(x) for x in ("click", 1, "view", 2, "purchase", 3, "signup", 4, "error", 5))), F.col("event_type"))
    return e.select("event_id", plugin.cast("long").alias("plugin_id"), F.col("user_id").alias("item_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("asked_at"), F.concat(F.lit("plugin:"), plugin.cast("string"), F.lit(":item:"), F.col("user_id").cast("string")).alias("key"))


REQ = "req as (select event_id, cast(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as bigint) as plugin_id, user_id as item_id, event_type, value, cast(props ->> '$.k' as bigint) as k, cast(floor(epoch(ts)) as bigint) as asked_at, 'plugin:' || case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end || ':item:' || user_id as key from events)"

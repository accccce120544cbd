"""Creating jobs from configurations and seeds, and deleting them with all that hangs off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecclimb.operators.relations import cascade_delete, stale_assemblies, unreferenced
from vecclimb.operators.upserts import checkin_items

#: Limits that a job gives to all its inputs, unless an input has its own.
LIMITS = ("max_iterations", "inference_limit", "time_limit")


def create_inputs(jobs: DataFrame, seeds: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inputs, items with unseen seeds added, seeds with item_id): a job's configuration for each of its inputs.

    jobs: job_id and LIMITS; seeds: job_id, input_no, assembly_index, item, external_id and LIMITS of the
    input, null where the job's hold; items: item_id, item. A job without seeds has no inputs.
    """
    own = seeds.groupBy("job_id", "input_no").agg(*(F.max(c).alias(f"_{c}") for c in LIMITS), F.count("*").alias("n_seeds"))
    inputs = jobs.join(own, "job_id").select("job_id", "input_no", "n_seeds", *(F.coalesce(f"_{c}", c).alias(c) for c in LIMITS))
    merged, out = checkin_items(items, seeds.select("job_id", "input_no", "assembly_index", "item", "external_id"))
    return inputs, merged, out


def config_violations(config: DataFrame, plugins: DataFrame, outputs: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, problem, plugin_id) of jobs whose configuration breaks a rule.

    config: job_id, role, plugin_id, assembly_index (of data sources); plugins: plugin_id, type, n_parents;
    outputs: plugin_id, assembly_index, embedding_id of mappers; links: plugin_id, embedding_id that a data source takes.
    Problems: unknown (no such plugin), type (a plugin in a role of another type), parents (an assembly of another
    number of parents than there are data sources), outputs (likewise a mapper), embedding (an output of the
    mapper goes to a data source that does not take it).
    """
    known = config.join(plugins, "plugin_id", "left")
    unknown = known.filter("type is null").select("job_id", F.lit("unknown").alias("problem"), "plugin_id")
    wrong = known.filter("type <> role").select("job_id", F.lit("type").alias("problem"), "plugin_id")
    sources = config.filter("role = 'data_source'")
    counts = sources.groupBy("job_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    parents = known.filter("role = 'assembly' and type is not null").join(counts, "job_id", "left").filter(n != F.col("n_parents")).select("job_id", F.lit("parents").alias("problem"), "plugin_id")
    mappers = config.filter("role = 'mapper'").select("job_id", "plugin_id")
    sizes = outputs.groupBy("plugin_id").agg(F.count("*").alias("n_outputs"))
    off = mappers.join(sizes, "plugin_id", "left").join(counts, "job_id", "left").filter(n != F.coalesce("n_outputs", F.lit(0))).select("job_id", F.lit("outputs").alias("problem"), "plugin_id")
    routed = mappers.join(outputs, "plugin_id").select("job_id", "assembly_index", "embedding_id").join(sources.select("job_id", "assembly_index", "plugin_id"), ["job_id", "assembly_index"])
    missed = routed.join(links, ["plugin_id", "embedding_id"], "left_anti").select("job_id", F.lit("embedding").alias("problem"), "plugin_id")
    return unknown.unionByName(wrong).unionByName(parents).unionByName(off).unionByName(missed).distinct()


def drop_orphan_products(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The store without products that no assembly has any more: their results, their sources by assembly plugins,
    and then all items that nothing refers to (N3, then N1).

    store: assemblies (assembly_id, product_id), components (assembly_id, item_id), sources (item_id, plugin_type),
    item_results (item_id), results (item_id), items (item_id). Only products that had an assembly plugin as
    their source lose their results.
    """
    made = store["sources"].filter("plugin_type = 'assembly'").select("item_id").distinct()
    orphans = made.join(store["assemblies"].select(F.col("product_id").alias("item_id")), "item_id", "left_anti")
    out = dict(store)
    out["item_results"] = store["item_results"].join(orphans, "item_id", "left_anti")
    mark = orphans.withColumn("plugin_type", F.lit("assembly"))
    out["sources"] = store["sources"].join(mark, ["item_id", "plugin_type"], "left_anti")
    references = [(out[t], c) for t, c in (("sources", "item_id"), ("item_results", "item_id"), ("results", "item_id"), ("components", "item_id"), ("assemblies", "product_id"))]
    unused = unreferenced(store["items"], "item_id", references)
    out["items"] = store["items"].join(unused.select("item_id"), "item_id", "left_anti")
    return out


def delete_jobs(store: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The store without the jobs of gone (job_id) and all that hung off them (N6, then N2, N3, N1, N4).

    store as for drop_orphan_products(), and jobs (job_id), links (job_id); results have job_id and assembly_id,
    assemblies required. Assemblies that no result refers to any more, or of a wrong number of components, go
    with their components.
    """
    left = cascade_delete({t: (store[t], "job_id") for t in ("jobs", "links", "results")}, gone, "job_id")
    stale = stale_assemblies(store["assemblies"], store["components"], left["results"])
    left |= cascade_delete({t: (store[t], "assembly_id") for t in ("assemblies", "components")}, stale, "assembly_id")
    return drop_orphan_products(store | left)

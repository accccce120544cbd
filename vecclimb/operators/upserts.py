"""Upserts as pure functions: (table, updates) -> the next version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecclimb.functions.scalars import assembly_key, completed_at, component_key, is_terminal, started_at
from vecclimb.operators.windows import last_seen


#: Ids that share a stem at most: a stem is an id without its last byte.
SLOTS = 256


def with_fresh_ids(fresh: DataFrame, key: str, known: DataFrame, name: str, stem: Column | None = None) -> DataFrame:
    """fresh with ids, the column name, that no other of its rows and no row of known has.

    fresh: distinct keys that known (column name) has no id for yet. An id is 56 bits of the key's hash, its stem, and a
    slot of 8 bits: the keys of one stem take the slots after those taken, in the order of the keys. So two keys
    whose hashes collide get two ids, though no id is counted up and no task sees more than a stem; an error if
    a stem has no slot left. stem gives another hash.
    """
    hashed = F.shiftright(F.xxhash64(key) if stem is None else stem, 8)
    taken = known.select(F.shiftright(name, 8).alias("_stem"), (F.pmod(name, F.lit(SLOTS)) + 1).alias("_taken")).groupBy("_stem").agg(F.max("_taken").alias("_taken"))
    within = Window.partitionBy("_stem").orderBy(key)
    placed = fresh.withColumn("_stem", hashed).withColumn("_slot", F.row_number().over(within) - 1).join(taken, "_stem", "left")
    slot = F.col("_slot") + F.coalesce("_taken", F.lit(0))
    checked = F.when(slot < SLOTS, F.shiftleft("_stem", 8) + slot).otherwise(F.raise_error(F.lit("a stem of ids has no slot left")).cast("long"))
    return placed.withColumn(name, checked).drop("_stem", "_slot", "_taken")


def checkin_items(items: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with unseen texts added, batch with item_id): known texts keep their ids.

    items: item_id, item; batch: item and anything else, repeated texts included.
    """
    fresh = batch.select("item").filter("item is not null").distinct().join(items, "item", "left_anti")
    merged = items.select("item_id", "item").unionByName(with_fresh_ids(fresh, "item", items, "item_id").select("item_id", "item"))
    return merged, batch.join(merged, "item", "left")


def merge_last(target: DataFrame, updates: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows of target overwritten by the last update of their key, and new keys."""
    last = last_seen(updates, keys, seq).drop(seq).select(*target.columns)
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last)


def checkin_assemblies(assemblies: DataFrame, batch: DataFrame, plugin: int) -> tuple[DataFrame, DataFrame]:
    """(assemblies with new keys added, components of the new ones).

    batch: product_id, components array<struct<assembly_index, item_id>>. The key tells the order of
    the parents and the product; equal keys are one assembly.
    """
    keyed = batch.withColumns({"assembly_key": assembly_key(F.lit(plugin), F.col("components"), F.col("product_id")), "component_key": component_key(F.lit(plugin), F.col("components"))})
    new = keyed.dropDuplicates(["assembly_key"]).join(assemblies, "assembly_key", "left_anti")
    new = with_fresh_ids(new, "assembly_key", assemblies, "assembly_id")
    merged = assemblies.select("assembly_id", "assembly_key", "component_key", "product_id").unionByName(new.select("assembly_id", "assembly_key", "component_key", "product_id"))
    return merged, new.select("assembly_id", F.inline("components"))


def create_assembly(assemblies: DataFrame, batch: DataFrame, plugin: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assemblies, components of new ones, the batch with accepted and assembly_id): get or create.

    batch: request_id, product_id, components. Components with indices other than 0 .. n - 1 are refused; equal
    parents in equal order with the same product are one assembly, old or new.
    """
    index = F.transform("components", lambda c: c["assembly_index"])
    good = F.coalesce(F.array_sort(index) == F.sequence(F.lit(0), F.size("components") - 1).cast("array<int>"), F.lit(False)) & (F.size("components") > 0)
    key = assembly_key(F.lit(plugin), F.col("components"), F.col("product_id"))
    judged = batch.withColumn("components", F.col("components").cast("array<struct<assembly_index:int,item_id:long>>")).withColumn("accepted", good).withColumn("assembly_key", F.when(F.col("accepted"), key))
    merged, parts = checkin_assemblies(assemblies, judged.filter("accepted").select("product_id", "components"), plugin)
    return merged, parts, judged.join(merged.select("assembly_key", "assembly_id"), "assembly_key", "left").drop("assembly_key")


def relink(links: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """links with those of every record that wanted names replaced; a null in wanted leaves a record without."""
    kept = links.join(wanted.select(key).distinct(), key, "left_anti")
    given = wanted.select(*links.columns)
    for c in links.columns:
        given = given.filter(F.col(c).isNotNull())
    return kept.unionByName(given.distinct())


def checkin_knn(items: DataFrame, sources: DataFrame, embeddings: DataFrame, hits: DataFrame, plugin: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, sources, embeddings) with what a search returned checked in (I8).

    hits: item, external_id, embedding_id, vec, seq; sources: item_id, plugin_id, external_id; embeddings: item_id,
    embedding_id, vec. The last hit of an item (and embedding) counts; hits without vec give no embedding.
    """
    merged, out = checkin_items(items, hits)
    sourced = merge_last(sources, out.select("item_id", F.lit(plugin).cast("long").alias("plugin_id"), "external_id", "seq"), ["item_id", "plugin_id"])
    embedded = merge_last(embeddings, out.filter("vec is not null").select("item_id", "embedding_id", "vec", "seq"), ["item_id", "embedding_id"])
    return merged, sourced, embedded


def upsert_results(results: DataFrame, updates: DataFrame) -> DataFrame:
    """Valid flags by (job_id, item_id, assembly_id), null assembly being a value; ids stay."""
    keys = ["job_id", "item_id", "assembly_id"]
    last = updates.groupBy(*keys).agg(F.max_by("valid", "seq").alias("new_valid"))  # groups take nulls as equal
    same = [results[k].eqNullSafe(last[k]) for k in keys]
    kept = results.join(last, same, "left").select("result_id", *(results[k] for k in keys), F.coalesce("new_valid", "valid").alias("valid"))
    fresh = last.join(results, same, "left_anti").select(F.xxhash64(*keys).alias("result_id"), *keys, F.col("new_valid").alias("valid"))
    return kept.unionByName(fresh)


def accumulate_counts(counts: DataFrame, updates: DataFrame) -> DataFrame:
    """Counts added by (result_id, iteration_id)."""
    return counts.unionByName(updates).groupBy("result_id", "iteration_id").agg(F.sum("count").alias("count"))


def link_pairs(links: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs with those added that are missing."""
    return links.unionByName(new.select(*links.columns)).distinct()


def stored_outputs(outputs: DataFrame) -> DataFrame:
    """Outputs to store: neither failed executions nor the dummy id -1."""
    return outputs.filter(F.coalesce("executed", F.lit(False)) & (F.col("item_id") != -1))


def update_records(records: DataFrame, updates: DataFrame, key: str, columns: list[str], rule: Column) -> DataFrame:
    """Given fields replaced where the record then meets the rule; else it stays, as refused."""
    over = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    new = records.join(over, key, "left").withColumns({f"_{c}": F.coalesce(f"_{c}", c) for c in columns})
    tried = new.select(key, *(F.col(f"_{c}").alias(c) for c in columns), *(F.col(c).alias(f"_{c}") for c in columns)).withColumn("refused", ~F.coalesce(rule, F.lit(False)))
    return tried.select(key, *(F.when(F.col("refused"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns), "refused")


def update_status(jobs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Status and detail where given; a finished job is not cancelled; times follow."""
    over = updates.select("job_id", F.col("status").alias("_status"), F.col("detail").alias("_detail"))
    out = jobs.join(over, "job_id", "left")
    refused = (F.col("_status") == "cancelled") & is_terminal(F.col("status"))
    changed = F.col("_status").isNotNull() & ~refused
    status = F.when(changed, F.col("_status")).otherwise(F.col("status"))
    out = out.withColumns({
        "started_at": F.when(changed, started_at(status, F.col("started_at"), now)).otherwise(F.col("started_at")),
        "completed_at": F.when(changed, completed_at(status, F.col("completed_at"), now)).otherwise(F.col("completed_at")),
        "detail": F.coalesce(F.when(~F.coalesce(refused, F.lit(False)), F.col("_detail")), "detail"),
        "_new": status,
    })
    return out.withColumn("status", F.col("_new")).drop("_new", "_status", "_detail")



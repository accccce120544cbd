"""Roles of user functions, and the plan that runs one over deduplicated requests (K1-K9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecclimb.operators.relations import cache_split, reassemble
from vecclimb.session import Workspace, ship

#: Roles by whether their results are always stored and whether they are looked up.
ROLES = {"embedding": (False, True), "data_source": (False, False), "filter": (False, True), "score": (True, True), "mapper": (False, False), "assembly": (True, True)}


@dataclass(frozen=True)
class Plugin:
    """A function in a role. build gives columns of the value from a request's columns, or None if failed."""

    plugin_id: int
    role: str
    build: Callable[[DataFrame], DataFrame]


def from_column(expression: Column, valid: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A role as a column: null values are invalid."""

    def build(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("value", expression)
        return out.withColumn("valid", F.col("value").isNotNull() if valid is None else F.coalesce(valid, F.lit(False))).withColumn("error", F.lit(None).cast("string"))

    return build


def _apart(function: Callable[[pd.DataFrame], pd.Series], batch: pd.DataFrame) -> tuple[list, list]:
    """Values and errors of the rows of a batch that failed, by calls on parts of it.

    A part that passes gives all its values. One that fails is halved down to its first failing row, which is called
    alone and keeps its own error. The next part is as large as failures were rare so far, so that there is a call
    for every row at most, apart from the halving, and far fewer where few rows fail.
    """
    n, at, failed = len(batch), 0, 0
    values, errors = [None] * n, [None] * n

    def called(a: int, b: int) -> str | None:
        try:
            out = list(function(batch.iloc[a:b]))
            if b - a > 1 and len(out) != b - a:
                return "length"
            values[a:b] = out[: b - a] if out else [out[0]]
        except Exception as e:  # noqa: BLE001 - any failure of a plugin is a result
            return f"{type(e).__name__}: {e}"[:500]
        return None

    while at < n:
        end = min(n, at + max(1, int(0.7 * at / failed)) if failed else at + max(1, n // 2))
        error = called(at, end)
        if error is None:
            at = end
            continue
        while end - at > 1:
            middle = (at + end) // 2
            found = called(at, middle)
            if found is None:
                at, error = middle, None
            else:
                end, error = middle, found
        if error is None:  # the last row of its part: known to fail, but not yet by itself
            error = called(at, end)
        errors[at], failed, at = error, failed + (error is not None), end
    return values, errors


def from_pandas(function: Callable[[pd.DataFrame], pd.Series], value_type: str, spread: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A role as a pandas function over batches: what it raises makes its batch invalid, row by row (K9).

    spread deals the rows to all shuffle partitions first, for a slow function over a table that is read by few tasks.
    """

    def build(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"value {value_type}, valid boolean, error string").fields])
        if spread:
            rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def run(batches):
            for batch in batches:
                try:
                    batch["value"], batch["error"] = list(function(batch)), None
                except Exception:  # the batch failed: find the rows that fail
                    batch["value"], batch["error"] = _apart(function, batch)
                batch["valid"] = [v is not None and e is None for v, e in zip(batch["value"], batch["error"])]
                yield batch

        return rows.mapInPandas(run, schema)

    return build


def execute_role(plugin: Plugin, requests: DataFrame, key: str, cache: DataFrame, store: DataFrame, use_cache: bool = True, use_store: bool = True, args: dict[str, Any] | None = None) -> DataFrame:
    """Every request with value, valid, error and source (K8).

    Requests of one key are executed once, and only if neither cache nor store (key, value) has
    them; roles that are never looked up follow ROLES, and either table can be switched off for a call. args are
    further columns that the plugin sees. It sees the remaining requests only: they are filtered before it,
    not inside it. What it gives is written to the shared folder once, so that results, failures and
    stored_results() of the same call do not run it again.
    """
    work = Workspace(requests.sparkSession, "role")
    looked_up = ROLES[plugin.role][1]
    cache, store = (t if looked_up and used else t.limit(0) for t, used in ((cache, use_cache), (store, use_store)))
    tagged = cache_split(requests.dropDuplicates([key]), cache, store, key)
    asked = tagged.filter("source = 'remaining'").withColumns({name: F.lit(value) for name, value in (args or {}).items()})
    done = work.save(plugin.build(asked).select(key, "value", "valid", "error", "source"), "done")
    known = tagged.filter("source <> 'remaining'").select(key, "source").join(cache.select(key, F.col("value").alias("_c")), key, "left").join(store.select(key, F.col("value").alias("_s")), key, "left")
    known = known.select(key, F.when(F.col("source") == "cache", F.col("_c")).otherwise(F.col("_s")).alias("value"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("error"), "source")
    return reassemble(requests, done.unionByName(known), key)


def stored_results(plugin: Plugin, executed: DataFrame, store: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """The next version of the store (key, value): with what was executed and is valid, if the role is always
    stored or the call asks to keep its results (K8, I9)."""
    if not (ROLES[plugin.role][0] or keep):
        return store
    new = executed.filter("source = 'remaining' and valid").select(key, "value").dropDuplicates([key])
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def failures(executed: DataFrame, plugin: Plugin, job_id: int, reason: str = "execution") -> DataFrame:
    """(job_id, plugin_id, reason, detail, request) of requests that failed (A10, K9)."""
    failed = executed.filter("not valid and source = 'remaining'")
    rest = [c for c in executed.columns if c not in ("value", "valid", "error", "source")]
    return failed.select(F.lit(job_id).alias("job_id"), F.lit(plugin.plugin_id).alias("plugin_id"), F.lit(reason).alias("reason"), F.col("error").alias("detail"), F.to_json(F.struct(*rest)).alias("request"))


def mapped(queries: DataFrame, outputs: Column) -> DataFrame:
    """A row for each output vector of a mapper, by position (K5)."""
    return queries.select(*(c for c in queries.columns if c != "vec"), F.posexplode(outputs).alias("assembly_index", "vec"))


def assembled(requests: DataFrame, products: Column) -> DataFrame:
    """A row for each product of ordered parents (K6)."""
    return requests.select("*", F.explode(products).alias("product"))


def violations(plugins: DataFrame, links: DataFrame) -> DataFrame:
    """(plugin_id, problem) of plugin records that break a rule (K7).

    plugins: plugin_id, type, batch_size, vector_length, metric, n_outputs, n_parents; links: plugin_id,
    embedding_id.
    """
    counted = plugins.join(links.groupBy("plugin_id").agg(F.count("*").alias("n_links")), "plugin_id", "left")
    of = F.col("type")
    rules = {
        "limit": F.col("batch_size") <= 0,
        "vector_length": (of == "embedding") & F.coalesce(F.col("vector_length") <= 0, F.lit(True)),
        "metric": (of == "embedding") & ~F.coalesce(F.col("metric").isin("Cosine", "Euclid", "Dot"), F.lit(False)),
        "no_embedding": (of == "data_source") & (F.coalesce("n_links", F.lit(0)) < 1),
        "outputs": (of == "mapper") & (F.coalesce("n_outputs", F.lit(0)) < 2),
        "parents": (of == "assembly") & (F.coalesce("n_parents", F.lit(0)) < 2),
    }
    found = F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))
    return counted.select("plugin_id", F.explode(F.array_compact(found)).alias("problem"))

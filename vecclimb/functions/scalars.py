"""Keys, text and state functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States after which a job does not change.
TERMINAL = ("complete", "complete_with_errors", "early_stop", "failed", "cancelled")


def request_key(plugin: Column, role: str, part: Column) -> Column:
    """plugin:{plugin}:{role}:{part}"""
    return F.concat(F.lit("plugin:"), plugin.cast("string"), F.lit(f":{role}:"), part.cast("string"))


def strip_key(key: Column, role: str) -> Column:
    """The part of a request key after its role."""
    return F.substring_index(key, f":{role}:", -1)


def ordered_ids(components: Column, index: str = "assembly_index", item: str = "item_id") -> Column:
    """Ids of an array of components, by index, joined by _."""
    return F.array_join(F.transform(F.array_sort(F.transform(components, lambda c: F.struct(c[index], c[item].cast("string").alias("id")))), lambda c: c["id"]), "_")


def component_key(plugin: Column, components: Column) -> Column:
    """{plugin}_{ids by index}: equal parents in another order have another key."""
    return F.concat_ws("_", plugin.cast("string"), ordered_ids(components))


def assembly_key(plugin: Column, components: Column, product: Column) -> Column:
    return F.concat_ws("_", component_key(plugin, components), product.cast("string"))


def extract_marks(text: Column) -> Column:
    """Distinct marks [X:nn] of a string, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[[A-Za-z]+:\d+\])"), F.lit(1)))


def count_parts(text: Column, separator: str = ".") -> Column:
    """Number of separated parts; an empty text has one."""
    return F.size(F.split(text, f"\\Q{separator}\\E", -1))


def count_of(text: Column, literal: str) -> Column:
    return F.regexp_count(text, F.lit(f"\\Q{literal}\\E"))


def concat_assembly(components: Column, index: str = "assembly_index", item: str = "item") -> Column:
    """The parents' texts joined in the order of their index."""
    return F.array_join(F.transform(F.array_sort(F.transform(components, lambda c: F.struct(c[index], c[item].alias("t")))), lambda c: c["t"]), "")


def over_limit(value: Column, limit: Column) -> Column:
    """Strictly over the limit; a null limit is never hit."""
    return F.coalesce(value > limit, F.lit(False))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def started_at(status: Column, started: Column, now: Column) -> Column:
    """Set once, when a job leaves created and queued."""
    return F.when(~status.isin("created", "queued"), F.coalesce(started, now)).otherwise(started)


def completed_at(status: Column, completed: Column, now: Column) -> Column:
    """Set once, when a job ends."""
    return F.when(is_terminal(status), F.coalesce(completed, now)).otherwise(completed)


def external_id_text(external_id: Column) -> Column:
    return external_id.cast("string")


def contiguous(low: Column, high: Column, different: Column, n: Column) -> Column:
    """Whether n indices are exactly 0 .. n-1."""
    return (low == 0) & (high == n - 1) & (different == n)


def config_path(config: Column, path: str) -> Column:
    return F.get_json_object(config, f"$.{path}")

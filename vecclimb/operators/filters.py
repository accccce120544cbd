"""Filters, scores of properties and record predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, filters: list[Column], valid: str = "valid") -> DataFrame:
    """Filters in order: a row that fails stays, as invalid, and later filters skip it (B1)."""
    out = rows
    for keep in filters:
        out = out.withColumn(valid, F.when(F.col(valid), F.coalesce(keep, F.lit(False))).otherwise(F.lit(False)))
    return out


def in_range(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """least <= value <= most, a missing bound being infinite; a null value fails (B2)."""
    checks = [value >= least] if least is not None else []
    checks += [value <= most] if most is not None else []
    return F.coalesce(reduce(lambda a, b: a & b, checks, value.isNotNull()), F.lit(False))


def in_ranges(bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """All properties lie in their ranges."""
    return reduce(lambda a, b: a & b, (in_range(F.col(c), *b) for c, b in bounds.items()), F.lit(True))


def matches_catalogue(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern of a catalogue occurs."""
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def pattern_count_in(text: Column, pattern: str, least: int | None = None, most: int | None = None) -> Column:
    """Whether the number of occurrences lies within bounds."""
    return in_range(F.regexp_count(text, F.lit(pattern)), least, most)


def combined(text: Column, ranges: dict, catalogue: list[str], counts: list[tuple[str, int | None, int | None]]) -> Column:
    """Ranges, then catalogue, then counts; an item without text is invalid."""
    keep = text.isNotNull() & in_ranges(ranges) & ~matches_catalogue(text, catalogue)
    return F.coalesce(reduce(lambda a, b: a & b, (pattern_count_in(text, *c) for c in counts), keep), F.lit(False))


def weighted_score(weights: list[tuple[str, float]]) -> Column:
    """Sum of weight * property; at least one, none twice."""
    names = [n for n, _ in weights]
    if not names or len(set(names)) < len(names):
        raise ValueError("a score needs at least one property, and each once")
    return reduce(lambda a, b: a + b, (F.col(n) * w for n, w in weights))


def normalised_config(config: DataFrame, known: DataFrame) -> DataFrame:
    """(plugin_id, kind, name, problem) of a table of bounds (plugin_id, kind, name, min, max).

    problem is dropped (no bounds, or max < min), duplicate, unknown (name not in known.name) or null;
    a plugin that is left without entries has a row with the problem empty.
    """
    usable = ~(F.col("min").isNull() & F.col("max").isNull()) & F.coalesce(F.col("min") <= F.col("max"), F.lit(True))
    marked = config.withColumn("usable", usable)
    dropped = marked.filter(~F.col("usable")).select("plugin_id", "kind", "name", F.lit("dropped").alias("problem"))
    rest = marked.filter("usable")
    counted = rest.groupBy("plugin_id", "kind", "name").agg(F.count("*").alias("n"))
    duplicate = counted.filter("n > 1").select("plugin_id", "kind", "name", F.lit("duplicate").alias("problem"))
    unknown = counted.join(known, "name", "left_anti").select("plugin_id", "kind", "name", F.lit("unknown").alias("problem"))
    fine = counted.filter("n = 1").join(known, "name", "left_semi").select("plugin_id", "kind", "name", F.lit(None).cast("string").alias("problem"))
    empty = config.select("plugin_id").distinct().join(rest, "plugin_id", "left_anti").select("plugin_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit("empty").alias("problem"))
    return reduce(DataFrame.unionByName, (dropped, duplicate, unknown, fine, empty))


def record_filter(wanted: dict[str, object]) -> Column:
    """AND of a condition for each entry: None is skipped, a list is IN, a text with % is LIKE, else equality."""

    def one(name: str, value: object) -> Column:
        if isinstance(value, (list, tuple, set)):
            return F.col(name).isin(*value)
        if isinstance(value, str) and "%" in value:
            return F.col(name).like(value)
        return F.col(name) == value

    return reduce(lambda a, b: a & b, (one(n, v) for n, v in wanted.items() if v is not None), F.lit(True))


def apply_overrides(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null values of overrides replace those of base."""
    over = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(over, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def missing_embedding(rows: DataFrame, embedded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that still have to be embedded, row by row."""
    return rows.join(embedded, keys, "left_anti")


def lookup(records: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Records with a key among the wanted ones."""
    return records.join(wanted.select(*keys).distinct(), keys, "left_semi")

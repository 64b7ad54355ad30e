"""Load levels: a range with a step, or a comma list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def range_levels(start: Column, stop: Column, step: Column) -> Column:
    """start..=stop by step as an array; start and step are at least 1."""
    first = F.greatest(start.cast("long"), F.lit(1))
    by = F.greatest(step.cast("long"), F.lit(1))
    none = F.array().cast("array<bigint>")
    return F.when(first <= stop, F.sequence(first, stop.cast("long"), by)).otherwise(none)


def list_levels(spec: Column) -> Column:
    """Comma list as an array: trimmed, blanks and zeros skipped.

    Null when an entry is no number or nothing is left; `rps_levels` turns that
    into an error.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(
        parts, lambda p: F.when(p.rlike("^[+]?[0-9]+$"), p.try_cast("long"))
    )
    good = F.filter(numbers, lambda v: v > 0)
    return F.when(F.forall(numbers, lambda v: v.isNotNull()) & (F.size(good) > 0), good)


def rps_levels(
    spark: SparkSession,
    spec: str | None = None,
    start: int = 1_000,
    stop: int = 64_000,
    step: int = 1_000,
) -> DataFrame:
    """One row per level, of a comma list if given, else of the range."""
    one = spark.range(1)
    if spec is None:
        levels = range_levels(F.lit(start), F.lit(stop), F.lit(step))
    else:
        message = F.lit(f"no load levels in {spec!r}")
        levels = F.coalesce(
            list_levels(F.lit(spec)), F.raise_error(message).cast("array<bigint>")
        )
    return one.select(F.explode(levels).alias("rps"))

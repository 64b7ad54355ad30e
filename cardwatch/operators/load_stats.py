"""Load-test statistics: exact nearest-rank percentiles, summaries, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.functions.features import floor_div
from cardwatch.sources.counters import COUNTERS, scrape_counters

MEASURES = ("e2e", "feature", "router", "l1", "l2", "serialize")
_BIN = 65_536


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """An equi-join in which null group keys match; keeps the left side's keys."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by]
    on = reduce(lambda a, b: a & b, same, F.lit(True))
    return left.join(named, on, how).drop(*[f"_right_{c}" for c in by])


def nearest_rank(df: DataFrame, by: list[str], value: str, ps: tuple[int, ...]) -> DataFrame:
    """Exact percentiles sorted[round(p/100 * (n-1))] of a whole-number column per group.

    Groups may hold most of the data, so no group is sorted in one task. Equal
    values are counted before the shuffle; ranks come from running totals over
    bins of the value range, then over the values within a bin.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", floor_div(F.col("_value"), _BIN))
    )
    group = Window.partitionBy(*by)
    earlier = Window.unboundedPreceding, -1
    bins = (
        counts.groupBy(*by, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .select(
            *by,
            "_bin",
            F.sum("_in_bin").over(group.orderBy("_bin").rowsBetween(*earlier)).alias("_bins_before"),
            F.sum("_in_bin").over(group).alias("_total"),
        )
    )
    in_bin = Window.partitionBy(*by, "_bin").orderBy("_value").rowsBetween(*earlier)
    zero = F.lit(0)
    first = F.coalesce(F.col("_bins_before"), zero) + F.coalesce(F.col("_values_before"), zero)
    placed = (
        counts.withColumn("_values_before", F.sum("_n").over(in_bin))
    )
    placed = join_groups(placed, bins, [*by, "_bin"], "inner").withColumn("_first", first)

    def at(p: int) -> Column:
        rank = F.round(F.lit(p / 100.0) * (F.col("_total") - 1).cast("double")).cast("long")
        here = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n"))
        return F.max(F.when(here, F.col("_value"))).alias(f"p{p}")

    return placed.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.sum(F.col("_n") * F.col("_value")).alias("total"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
        *[at(p) for p in ps],
    )


def long_measures(samples: DataFrame, by: list[str], measures: tuple[str, ...]) -> DataFrame:
    """Samples as (by..., stage, us) rows."""
    stack = ", ".join(f"'{m}', {m}_us" for m in measures)
    return samples.selectExpr(*by, f"stack({len(measures)}, {stack}) AS (stage, us)")


def stage_histograms(samples: DataFrame) -> DataFrame:
    """Per stage: count, sum, extremes and percentiles of the recorded µs.

    The second model counts only where it ran (`used_l2`).
    """
    if "used_l2" in samples.columns:
        samples = samples.withColumn("l2_us", F.when(F.col("used_l2"), F.col("l2_us")))
    measures = tuple(m for m in MEASURES if f"{m}_us" in samples.columns)
    return nearest_rank(long_measures(samples, [], measures), ["stage"], "us", (50, 95, 99))


def bench_lag(ticks: DataFrame) -> DataFrame:
    """p99 and maximum schedule lag per level, in µs, over all ticks."""
    us = ticks.withColumn("lag_us", floor_div(F.col("lag_ns"), 1_000))
    return nearest_rank(us, ["runtime", "rps"], "lag_us", (99,)).select(
        "runtime",
        "rps",
        F.col("p99").alias("bench_lag_p99_us"),
        F.col("max").alias("bench_lag_max_us"),
    )


def missed_ticks(ticks: DataFrame) -> DataFrame:
    """Whole intervals by which ticks ran behind, per level."""
    interval = F.greatest(
        F.call_function("div", F.lit(1_000_000_000), F.greatest(F.col("rps"), F.lit(1))), F.lit(1)
    )
    behind = F.when(F.col("lag_ns") > interval, F.call_function("div", F.col("lag_ns"), interval))
    return ticks.groupBy("runtime", "rps").agg(
        F.coalesce(F.sum(behind), F.lit(0)).alias("missed_ticks_total")
    )


def bench_summary(
    samples: DataFrame,
    ticks: DataFrame | None = None,
    levels: DataFrame | None = None,
    scrapes: DataFrame | None = None,
) -> DataFrame:
    """One row per (runtime, rps) that any input has, whatever came back of it.

    Percentiles are over ok samples only; numbers that an input lacks are 0, and
    scraped counters null.
    """
    key = ["runtime", "rps"]
    good = samples.filter("ok")
    given = [df.select(*key) for df in (samples, ticks, levels, scrapes) if df is not None]
    totals = samples.groupBy(*key).agg(
        F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("err")
    )
    out = join_groups(reduce(DataFrame.union, given).distinct(), totals, key, "left")
    ranks = nearest_rank(long_measures(good, key, MEASURES), [*key, "stage"], "us", (50, 95, 99))

    def of(stage: str, p: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(p)))

    wide = ranks.groupBy(*key).agg(
        *[of("e2e", p).alias(f"{p}_us") for p in ("p50", "p95", "p99")],
        *[of(m, "p99").alias(f"{m}_p99_us") for m in MEASURES[1:]],
    )
    zero_filled = ["ok", "err", *[c for c in wide.columns if c not in key]]
    out = join_groups(out, wide, key, "left")
    if levels is not None:
        dropped = levels.groupBy(*key).agg(F.sum("dropped").alias("dropped"))
        out = join_groups(out, dropped, key, "left")
    else:
        out = out.withColumn("dropped", F.lit(0).cast("long"))
    zero_filled.append("dropped")
    if ticks is not None:
        out = join_groups(out, bench_lag(ticks), key, "left")
        out = join_groups(out, missed_ticks(ticks), key, "left")
        zero_filled += ["bench_lag_p99_us", "bench_lag_max_us", "missed_ticks_total"]
    if scrapes is not None:
        counters = scrape_counters(scrapes).groupBy(*key).agg(*[F.max(c).alias(c) for c in COUNTERS])
        out = join_groups(out, counters, key, "left")
    return out.fillna(0, zero_filled)


def router_counters(
    scored: DataFrame, *by: str | Column, more: tuple[Column, ...] = ()
) -> DataFrame:
    """Totals of what the router did, and `more` aggregates, over everything or per group."""
    totals = [
        F.count_if(F.col("route") == "l2").alias("router_l2_trigger_total"),
        F.count_if(F.col("decision") == "degrade_allow").alias("router_deadline_miss_total"),
        F.count_if(F.col("route") == "skipped_budget").alias("router_l2_skipped_budget_total"),
        F.count_if(F.col("route") == "timeout_before_l2").alias("router_timeout_before_l2_total"),
    ]
    return scored.groupBy(*by).agg(*totals, *more)


def decision_mix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))

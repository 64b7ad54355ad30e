"""Search for the load level at which latency breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def prev_level_p99(summary: DataFrame) -> DataFrame:
    """Adds `prev_p99_us`: p99 of the runtime's last earlier level without drops."""
    earlier = (
        Window.partitionBy("runtime").orderBy("rps").rowsBetween(Window.unboundedPreceding, -1)
    )
    clean = F.when((F.col("ok") > 0) & (F.col("dropped") == 0), F.col("p99_us"))
    return summary.withColumn("prev_p99_us", F.last(clean, ignorenulls=True).over(earlier))


def knee_reasons(summary: DataFrame, rise_pct: float = 0.30, abs_us: int = 200) -> DataFrame:
    """Adds `reason`: why a level is a knee, null if it is none."""
    prev, p99 = F.col("prev_p99_us"), F.col("p99_us")
    rise = F.round(prev.cast("double") * F.lit(1.0 + rise_pct)).cast("long")
    jumped = (F.col("ok") > 0) & (prev > 0) & (p99 > rise) & (p99 > prev + abs_us)
    return prev_level_p99(summary).withColumn(
        "reason",
        F.when(F.col("dropped") > 0, F.concat(F.lit("dropped "), F.col("dropped").cast("string")))
        .when(jumped, F.concat_ws(" ", F.lit("p99"), prev, F.lit("to"), p99)),
    )


def find_knee(summary: DataFrame, rise_pct: float = 0.30, abs_us: int = 200) -> DataFrame:
    """Levels up to the first at which any runtime has a reason; all if none has."""
    judged = knee_reasons(summary, rise_pct, abs_us)
    # A scalar subquery: one number, whatever the size of the summary.
    knee = judged.filter(F.col("reason").isNotNull()).select(F.min("rps")).scalar()
    return judged.withColumn("knee_rps", knee).filter(
        F.col("knee_rps").isNull() | (F.col("rps") <= F.col("knee_rps"))
    )


def compare_targets(summary: DataFrame, runtimes: list[str], measure: str = "p99_us") -> DataFrame:
    """One row per level, one column per runtime."""
    return summary.groupBy("rps").pivot("runtime", runtimes).agg(F.max(measure))

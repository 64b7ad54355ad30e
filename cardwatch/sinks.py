"""Writers of scored rows and load summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.sources.counters import COUNTERS

RESPONSE_COLUMNS = ("trace_id", "score", "decision", "reason", "timings_us")

# Columns of the summary file, in order.
SUMMARY_COLUMNS = (
    "ts_ms",
    "runtime",
    "url",
    "metrics_url",
    "rps",
    "duration_s",
    "concurrency",
    "ok",
    "err",
    "dropped",
    "p50_us",
    "p95_us",
    "p99_us",
    "feature_p99_us",
    "router_p99_us",
    "l1_p99_us",
    "l2_p99_us",
    "serialize_p99_us",
    "router_l2_trigger_total",
    "router_deadline_miss_total",
    "router_l2_skipped_budget_total",
    "router_timeout_before_l2_total",
    "bench_lag_p99_us",
    "bench_lag_max_us",
    "missed_ticks_total",
)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which all executors must share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/cardwatch-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to a shared folder and read from there: cuts the lineage."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes what a query has written and nobody reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).delete(where, True)


def response_json(scored: DataFrame) -> DataFrame:
    """Scored rows as JSON lines in the response form."""
    return scored.select(F.to_json(F.struct(*RESPONSE_COLUMNS)).alias("value"))


def sink_scored(scored: DataFrame, path: str, format: str = "json", mode: str = "append") -> None:
    scored.select(*RESPONSE_COLUMNS).write.mode(mode).format(format).save(path)


def summary_rows(
    summary: DataFrame,
    ts_ms: Column | None = None,
    urls: dict[str, tuple[str, str]] | None = None,
    duration_s: int = 20,
    concurrency: int = 200,
) -> DataFrame:
    """The summary in the file's columns; counters without decimals, absent ones empty.

    urls: for each runtime its own (url, metrics_url); empty for others.
    """

    def target(which: int) -> Column:
        found = F.lit("")
        for runtime, pair in (urls or {}).items():
            found = F.when(F.col("runtime") == runtime, pair[which]).otherwise(found)
        return found

    given = {
        "ts_ms": F.unix_millis(F.current_timestamp()) if ts_ms is None else ts_ms,
        "url": target(0),
        "metrics_url": target(1),
        "duration_s": F.lit(duration_s),
        "concurrency": F.lit(concurrency),
    }
    for c in COUNTERS:
        value = F.col(c) if c in summary.columns else F.lit(None).cast("double")
        given[c] = F.when(value.isNotNull(), F.format_string("%.0f", F.rint(value)))
    return summary.select(*[given.get(c, F.col(c)).alias(c) for c in SUMMARY_COLUMNS])


def sink_bench_csv(rows: DataFrame, path: str) -> None:
    """Appends; each part file starts with the header, quotes are doubled."""
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)

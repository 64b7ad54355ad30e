"""Registered streaming queries: a whole table as a stream, run to its end."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.config import Config
from cardwatch.schemas import RESPONSE
from cardwatch.sinks import RESPONSE_COLUMNS, remove_folder, shared_folder
from cardwatch.sources.requests import dead_letter_split, decode_requests, encode_requests
from cardwatch.sources.tables import faulty_requests, read_table, transactions
from cardwatch.streaming import score
from cardwatch.streaming.state import store_features_stream, stored_buckets

CFG = Config()
#: A table is run in so many micro-batches, however many files hold it: each of them costs a
#: round over all partitions of the state.
BATCHES = 5


def _run(spark: SparkSession, rows: DataFrame, folder: str, schema, name: str = "out") -> DataFrame:
    """Runs the stream over what is there and reads the files it wrote."""
    query = score.start_sink(
        rows, f"{folder}/{name}", f"{folder}/{name}-state", format="parquet", available_now=True
    )
    query.awaitTermination()
    remove_folder(spark, f"{folder}/{name}-state")
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _share(files: int) -> dict[str, str]:
    """How many of the files a micro-batch takes."""
    return {"maxFilesPerTrigger": str(max(1, -(-files // BATCHES)))}


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The whole `events` table as request files in arrival order, opened as a stream.

    In several micro-batches, so users have rows in several and state is read back.
    """
    folder = shared_folder(spark)
    tx = transactions(read_table(spark, d, "events"))
    files = score.publish(encode_requests(tx), f"{folder}/in", BATCHES)
    valid, _ = dead_letter_split(score.read_requests(spark, f"{folder}/in", **_share(files)))
    return valid, folder


def stream_features(spark, d):
    tx, folder = _requests(spark, d)
    out = store_features_stream(tx.select("user_id", "arrival_seq", "event_time_ms", "amount"), CFG)
    names = ("velocity_60s", "velocity_300s", "amount_sum_60s", "amount_sum_300s")
    return _run(spark, out, folder, out.schema).select(
        "user_id",
        "arrival_seq",
        *[F.round(c, 6).alias(c) for c in names],
        "inter_arrival_ms",
        "oo_order_flag",
    )


def stream_state(spark, d):
    """What is stored when the stream has ended: no bucket behind the user's last window."""
    tx, folder = _requests(spark, d)
    out = store_features_stream(tx.select("user_id", "arrival_seq", "event_time_ms", "amount"), CFG)
    query = score.start_sink(
        out, f"{folder}/out", f"{folder}/out-state", format="parquet", available_now=True
    )
    query.awaitTermination()
    stored = stored_buckets(spark, f"{folder}/out-state")
    return stored.withColumn("amount_sum", F.round("amount_sum", 6))


def stream_responses(spark, d):
    tx, folder = _requests(spark, d)
    out = score.stream_score(tx, cfg=CFG, repeatable_ids=True).select(*RESPONSE_COLUMNS)
    return _run(spark, out, folder, RESPONSE).select(
        "trace_id", F.round("score", 6).alias("score"), "decision", F.size("reason").alias("items")
    )


def stream_clamped(spark, d):
    """The future clamp with an ingest time 30 s behind, or 90 s for every third row."""
    tx, folder = _requests(spark, d)
    behind = F.when(F.col("arrival_seq") % 3 == 0, 90_000).otherwise(30_000)
    tx = tx.select("user_id", "arrival_seq", "event_time_ms", "amount").withColumn(
        "ingest_time_ms", F.col("event_time_ms") - behind
    )
    out = store_features_stream(tx, CFG)
    return _run(spark, out, folder, out.schema).select(
        "user_id", "arrival_seq", "inter_arrival_ms", "oo_order_flag"
    )


def needed_lateness(spans: list[tuple[int | None, int | None]]) -> int:
    """The longest time that a row can lie behind one read no later, in ms.

    spans: earliest and latest time of each part of what is read, in order. The rows of a
    part come in any order, so each row of it may come after its latest.
    """
    spans = [s for s in spans if s[0] is not None]
    lows = list(accumulate((low for low, _ in reversed(spans)), min))[::-1]
    highs = accumulate((high for _, high in spans), max)
    return max((high - low for low, high in zip(lows, highs, strict=True)), default=0)


def _written_lateness(rows: DataFrame) -> int:
    """`needed_lateness` of written rows that are read file by file, in the order of the files'
    times. It holds for any cut into micro-batches; files of one time come in any order."""
    spans = rows.groupBy(F.col("_metadata.file_modification_time").alias("_at")).agg(
        F.min("event_time_ms").alias("low"), F.max("event_time_ms").alias("high")
    )
    return needed_lateness([(r.low, r.high) for r in spans.orderBy("_at").collect()])


def stream_counters(spark, d):
    """Scored rows as one stream, its sink as the input of a report by minutes.

    Windows that are still open at the end are reported as well. The lateness is as long as
    the files of the sink need, so no row is dropped.
    """
    tx, folder = _requests(spark, d)
    names = ("event_time_ms", "route", "decision", "before_us", "total_us")
    scored = (
        score.stream_scored_features(tx, cfg=CFG)
        .withColumnsRenamed({"elapsed_before_l2_us": "before_us", "elapsed_total_us": "total_us"})
        .select(*names)
    )
    written = _run(spark, scored, folder, scored.schema)
    lateness = f"{_written_lateness(written) + 1} milliseconds"
    log = spark.readStream.schema(scored.schema).options(**_share(len(written.inputFiles())))
    counted = score.stream_metrics(log.parquet(f"{folder}/out"), "1 minute", lateness, ("before", "total"))
    query = score.start_report(counted, f"{folder}/report", f"{folder}/report-state", available_now=True)
    query.awaitTermination()
    remove_folder(spark, f"{folder}/report-state")
    return score.read_report(spark, f"{folder}/report", counted.schema)


def stream_dead_letters(spark, d):
    """Plain request lines with planted faults: lines of each cause that a stream sets aside."""
    folder = shared_folder(spark)
    lines = faulty_requests(transactions(read_table(spark, d, "events")))
    files = score.publish(lines, f"{folder}/in", BATCHES, text=True)
    decoded = score.read_request_lines(spark, f"{folder}/in", **_share(files))
    _, dead = dead_letter_split(decoded)
    found = _run(spark, dead, folder, dead.schema)
    return found.groupBy("cause").agg(F.count("*").alias("n"), F.count_distinct("arrival_seq").alias("numbers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_store_features": stream_features,
        "stream_state": stream_state,
        "stream_score": stream_responses,
        "stream_future_clamp": stream_clamped,
        "stream_metrics": stream_counters,
        "stream_dead_letters": stream_dead_letters,
    }

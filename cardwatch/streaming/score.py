"""Continuous scoring: request lines in, responses out."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cardwatch.config import Config
from cardwatch.models import Models, default_models
from cardwatch.operators.features import with_row_features
from cardwatch.operators.load_stats import router_counters
from cardwatch.operators.lookup import mcc_risk_lookup
from cardwatch.plans.score import scored_record, slim, with_scores
from cardwatch.sources.requests import decode_requests
from cardwatch.streaming.state import stateful_settings, store_features_stream

# A request line with its arrival number; the other columns may be absent.
LINES = "arrival_seq long, elapsed_before_l2_us long, elapsed_total_us long, value string"


def read_requests(
    spark: SparkSession, path: str, ingest_time_ms: Column | None = None, **options: str
) -> DataFrame:
    """Stream of decoded request lines from JSON files, with `cause` of a dead letter.

    Arrival order across micro-batches is the order of the files; within one it
    is `arrival_seq`. So files must come in arrival order, as `publish` writes them; where
    micro-batches are cut then changes nothing but the work of each. One of
    `maxFilesPerTrigger` and `maxBytesPerTrigger` can be given to bound that; 2 GB is
    taken if neither is. `ingest_time_ms` is the "now" of the future clamp: pass `now_ms()`
    in production, nothing for a replay.
    """
    given = {"maxFilesPerTrigger", "maxBytesPerTrigger"} & options.keys()
    limits = {} if given else {"maxBytesPerTrigger": str(2 * 1024**3)}
    lines = spark.readStream.schema(LINES).options(**limits | options).json(path)
    decoded = decode_requests(lines).drop("value")
    return decoded if ingest_time_ms is None else decoded.withColumn("ingest_time_ms", ingest_time_ms)


def read_request_lines(
    spark: SparkSession, path: str, stream: bool = True, **options: str
) -> DataFrame:
    """Decoded plain request lines, one per line of text files, with arrival numbers.

    The number of a line is made of its file's modification time in ms, the first byte of
    the part of the file that a task reads, and the line's place in that task. It grows with
    the files' times and with the place in a file, wherever files are cut into parts; a file
    of any size is read by as many tasks as it has parts. Files must differ in their time,
    as files of one writer do. Lines that carry numbers of their own are read by
    `read_requests`. Start a stream of them with `start_sink`.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.options(**options).text(path)
    wide = [
        (F.unix_millis("_metadata.file_modification_time"), 2**76),
        (F.col("_metadata.file_block_start"), 2**33),
        (F.monotonically_increasing_id().bitwiseAND(2**33 - 1), 1),
    ]
    number = sum(c.cast("decimal(20,0)") * F.lit(Decimal(by)) for c, by in wide)
    lines = lines.select(number.cast("decimal(38,0)").alias("arrival_seq"), "value")
    return decode_requests(lines.filter(F.trim("value") != ""))


#: Bytes and lines of a published file.
FILE_BYTES, FILE_ROWS = 100 * 1024**2, 2_000_000


def publish(
    lines: DataFrame,
    path: str,
    files: int | None = None,
    order: str = "arrival_seq",
    text: bool = False,
) -> int:
    """Writes lines in arrival order: as JSON with their columns, or as plain text.

    Arrival is cut into ranges, one sorted file each: as many as keep a file below 100 MB
    and 2 million lines, or at least `files`. One job writes them all into a folder that
    readers don't look at; then they are moved to `path` one by one in the order of their
    ranges, each with a later time than all before it. So a reader may take any number of
    files at a time: what is cut changes no result. Returns the number of files. The
    store must be able to set a file's time.
    """
    size = lines.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).first()
    asked = max(files or 1, -(-size["n"] // FILE_ROWS), -(-(size["bytes"] or 0) // FILE_BYTES))
    ranges = lines.repartitionByRange(asked, F.asc_nulls_first(order)).sortWithinPartitions(order)
    hidden = f"{path}/.unpublished-{uuid.uuid4()}"
    (ranges.select("value").write.text if text else ranges.write.json)(hidden)

    spark = lines.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs.Path
    target = paths(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = max((f.getModificationTime() for f in fs.listStatus(target)), default=0)
    first = max(newest + 1, time.time_ns() // 1_000_000)
    parts = sorted(f.getPath().getName() for f in fs.listStatus(paths(hidden)))
    parts = [name for name in parts if name.startswith("part-")]
    for k, name in enumerate(parts):
        at = paths(hidden, name)
        fs.setTimes(at, first + k, -1)
        if not fs.rename(at, paths(target, name)):
            raise OSError(f"could not publish {name} in {path}")
    fs.delete(paths(hidden), True)
    return len(parts)


def now_ms() -> Column:
    """Time of the micro-batch."""
    return F.unix_millis(F.current_timestamp())


def stream_scored_features(
    tx: DataFrame, models: Models | None = None, cfg: Config = Config()
) -> DataFrame:
    features = store_features_stream(slim(with_row_features(tx)), cfg)
    return with_scores(features, models or default_models(), cfg)


def stream_score(
    tx: DataFrame,
    models: Models | None = None,
    cfg: Config = Config(),
    repeatable_ids: bool = False,
) -> DataFrame:
    """Streaming transactions to streaming responses."""
    return scored_record(stream_scored_features(tx, models, cfg), repeatable_ids)


def start_scoring(
    tx: DataFrame,
    risks: Callable[[SparkSession], DataFrame],
    path: str,
    checkpoint: str,
    models: Models | None = None,
    cfg: Config = Config(),
    available_now: bool = False,
) -> StreamingQuery:
    """Scores a stream with a table of category risks that is read anew each micro-batch.

    `risks` opens the table (mcc, risk); a change of it counts from the next micro-batch on.
    Responses of a micro-batch are written as JSON to a folder of its number, over what an
    earlier attempt at it may have left.
    """
    slimmed = slim(with_row_features(tx), "mcc")
    features = store_features_stream(slimmed, cfg)

    def write(rows: DataFrame, batch: int) -> None:
        rated = mcc_risk_lookup(rows, risks(rows.sparkSession))
        scored = scored_record(with_scores(rated, models or default_models(), cfg))
        scored.write.mode("overwrite").json(f"{path}/batch={batch}")

    writer = features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with stateful_settings(tx.sparkSession):
        return writer.start()


#: Upper bounds, in us, of the stages' histogram; the last one is open.
BOUNDS_US = (1_000, 5_000, 10_000)


def _distribution(stage: str) -> list[Column]:
    """Count, total, extremes and histogram of a recorded stage time."""
    us = F.col(f"{stage}_us")
    edges = [*zip((None, *BOUNDS_US), (*BOUNDS_US, None), strict=True)]
    inside = [
        (F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high)
        for low, high in edges
    ]
    names = [*[f"{stage}_le_{high}us" for high in BOUNDS_US], f"{stage}_gt_{BOUNDS_US[-1]}us"]
    return [
        F.count(us).alias(f"{stage}_n"),
        F.sum(us).alias(f"{stage}_sum_us"),
        F.min(us).alias(f"{stage}_min_us"),
        F.max(us).alias(f"{stage}_max_us"),
        *[F.count_if(us.isNotNull() & c).alias(n) for c, n in zip(inside, names, strict=True)],
    ]


def with_live_counters(
    scored: DataFrame, name: str = "router", stages: tuple[str, ...] = ()
) -> DataFrame:
    """Counts, and distributions of recorded stage times (columns `<stage>_us`), per
    micro-batch, delivered to query listeners and `lastProgress`."""
    is_route = F.col("route")
    return scored.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_route == "l2").alias("router_l2_trigger_total"),
        F.count_if(F.col("decision") == "degrade_allow").alias("router_deadline_miss_total"),
        F.count_if(is_route == "skipped_budget").alias("router_l2_skipped_budget_total"),
        F.count_if(is_route == "timeout_before_l2").alias("router_timeout_before_l2_total"),
        *[c for stage in stages for c in _distribution(stage)],
    )


def stream_metrics(
    scored: DataFrame,
    window: str = "1 hour",
    lateness: str = "1 hour",
    stages: tuple[str, ...] = (),
) -> DataFrame:
    """Router counters, and distributions of recorded stage times, per event-time window.

    A report: the watermark is safe here. In append mode a window comes once, when it
    lies a `lateness` behind; in update mode (`start_report`) whenever it has new rows.
    """
    timed = scored.withColumn("event_time", F.timestamp_millis("event_time_ms"))
    windowed = timed.withWatermark("event_time", lateness)
    more = tuple(c for stage in stages for c in _distribution(stage))
    counted = router_counters(windowed, F.window("event_time", window), more=more)
    return counted.select(F.unix_millis("window.start").alias("window_start_ms"), "*").drop("window")


def start_sink(
    responses: DataFrame,
    path: str,
    checkpoint: str,
    format: str = "json",
    available_now: bool = False,
) -> StreamingQuery:
    """Appends to files, exactly once; the checkpoint holds offsets and state.

    `available_now` ends after what is there; do not combine it with an idle
    timeout, which asks for batches for ever.
    """
    writer = (
        responses.writeStream.format(format)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    with stateful_settings(responses.sparkSession):
        return writer.start()


def start_report(
    counted: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keeps a report of `stream_metrics` up to date, windows still open included.

    Each micro-batch writes the windows that it changed into a folder of its own number,
    over what an earlier attempt at it may have left; so a repeated micro-batch counts once.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The report as of its last micro-batch: of each window the newest row."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(with_batch).parquet(path)
    newest = written.groupBy("window_start_ms").agg(
        F.max_by(F.struct(*schema.names), "batch").alias("row")
    )
    return newest.select("row.*")

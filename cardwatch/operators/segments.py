"""Cuts heavy users into bounded segments so that no task holds a whole heavy user.

Window features of a user depend on the user's earlier arrivals only through
(a) the largest event time so far and (b) the amounts per 100 ms bucket of the
last window. A heavy user is therefore cut by arrival order into segments, and
each segment is seeded with a few rows that stand for everything before it.
Downstream operators partition by (user, segment) and need not know more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from cardwatch.config import Config
from cardwatch.functions import features as X
from cardwatch.operators.ranks import with_positions
from cardwatch.operators.spread import spread

# Working columns next to the caller's own.
WORK = ("_segment", "_time", "_low", "_bucket", "_n", "_sum", "_real")


class Users(NamedTuple):
    """Users that ask for more than one task, or for totals instead of frames."""

    heavy: DataFrame | None
    dense: DataFrame | None
    #: There are too many to list: the dense way serves everybody.
    all_dense: bool = False
    #: Rows of all users.
    rows: int = 0


def unusual_users(events: DataFrame, cfg: Config, key: str = "user_id") -> Users:
    """Users with more than `cfg.heavy_rows` rows, and those with more than
    `cfg.dense_rows` of them per long window.

    Reads keys and times and counts with map-side combine. The driver sees at most
    `cfg.heavy_listed` + 1 keys; only a list within that bound is broadcast.
    """
    windows = F.greatest((F.max("_bucket") - F.min("_bucket") + 1) / cfg.long_buckets, F.lit(1.0))
    rows = F.count(F.lit(1))
    found = events.groupBy(key).agg(
        (rows > cfg.heavy_rows).alias("heavy"), (rows / windows > cfg.dense_rows).alias("dense")
    )
    found = found.filter("heavy OR dense")
    listed = found.limit(cfg.heavy_listed + 1).collect()
    total = events.count()
    if len(listed) > cfg.heavy_listed:
        return Users(found.filter("heavy").select(key), None, True, total)

    def of(kind: str) -> DataFrame | None:
        own = [(r[key],) for r in listed if r[kind] and r[key] is not None]
        schema = found.select(key).schema
        return F.broadcast(events.sparkSession.createDataFrame(own, schema)) if own else None

    return Users(of("heavy"), of("dense"), rows=total)


def arrivals(tx: DataFrame, cfg: Config) -> DataFrame:
    """Adds event time after the future clamp, its bucket, and the row's own weight."""
    ingest = F.col("ingest_time_ms") if "ingest_time_ms" in tx.columns else None
    time = X.event_time(F.col("event_time_ms"), ingest, cfg)
    return (
        tx.withColumn("_time", time)
        .withColumns(
            {
                "_segment": F.lit(0).cast("long"),
                "_low": F.col("_time"),
                "_bucket": X.bucket(F.col("_time"), cfg),
                "_n": F.lit(1).cast("long"),
                "_sum": F.col("amount"),
                "_real": F.lit(True),
            }
        )
    )


def with_lateness_columns(
    rows: DataFrame, cfg: Config, key: str = "user_id", order: str = "arrival_seq"
) -> DataFrame:
    """Running maxima in arrival order and what follows from them, per (user, segment)."""
    ordered = Window.partitionBy(key, "_segment").orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = F.col("_prev") - F.col("_time")
    known = F.col("_prev") > 0
    return (
        rows.withColumns(
            {"_prev": F.max("_time").over(before), "_low": F.min("_low").over(so_far)}
        )
        .withColumns(
            {
                "_run": F.greatest(X.bucket(F.col("_prev"), cfg), F.col("_bucket")),
                "_late": F.coalesce(known & (behind > 0), F.lit(False)),
                "_severe": F.coalesce(known & (behind > cfg.late_tolerance_ms), F.lit(False)),
            }
        )
        .withColumn("_run", F.when(F.col("_real"), F.col("_run")).otherwise(F.col("_bucket")))
        .withColumn("_held", ~F.col("_severe") & F.col("_n").isNotNull())
    )


def segmented(
    tx: DataFrame, cfg: Config, key: str = "user_id", order: str = "arrival_seq"
) -> tuple[DataFrame, Users]:
    """Rows of `tx` with their segment, plus the seed rows of heavy users' segments; and
    which users are heavy or dense.

    Users below `cfg.heavy_rows` stay in one segment and cost nothing extra. Heavy users'
    rows get their place in arrival order from ranges, whatever the numbers are, and are
    written once to the shared folder; a segment is `cfg.segment_rows` places. With heavy
    users the input is read four times: for the counts, for the ranges, and the rows of
    heavy and of other users; without, twice. All rows are counted besides, without columns:
    where they ask for more tasks than shuffles have anyway, they get them.
    """
    events = arrivals(tx, cfg)
    users = unusual_users(events, cfg, key)
    if users.heavy is None:
        return spread(events, users.rows, key), users

    light = events.join(users.heavy, key, "left_anti")
    hot = events.join(users.heavy, key, "left_semi").drop("_segment")
    hot = with_positions(hot, [F.col(order)], "_place", by=[key])
    hot = hot.withColumn("_segment", X.floor_div(F.col("_place"), cfg.segment_rows)).drop("_place")

    starts = _time_seeds(hot, key)
    seeds = starts.unionByName(
        _bucket_seeds(hot, starts, cfg, key, order, users.rows), allowMissingColumns=True
    ).withColumn("_real", F.lit(False))
    rows = light.unionByName(hot).unionByName(seeds, allowMissingColumns=True)
    return spread(rows, users.rows, key, "_segment"), users


def _time_seeds(hot: DataFrame, key: str) -> DataFrame:
    """Largest and smallest event time before each segment: one row per segment."""
    earlier = (
        Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hot.groupBy(key, "_segment")
        .agg(F.max("_time").alias("top"), F.min("_time").alias("low"))
        .select(
            key,
            "_segment",
            F.max("top").over(earlier).alias("_time"),
            F.min("low").over(earlier).alias("_low"),
        )
        .filter(F.col("_time").isNotNull())
    )


def _bucket_seeds(
    hot: DataFrame, starts: DataFrame, cfg: Config, key: str, order: str, rows: int
) -> DataFrame:
    """Accepted count and sum per bucket before each segment.

    At most two long windows of buckets per segment: totals are accumulated per
    (user, bucket) and listed only for the segments that can still see the bucket.
    """
    seeded = hot.select(key, order, *WORK).unionByName(starts, allowMissingColumns=True)
    seeded = spread(seeded, rows, key, "_segment")
    held = (
        with_lateness_columns(seeded, cfg, key, order)
        .filter("_held")
        .groupBy(key, "_segment", "_bucket")
        .agg(F.sum("_n").alias("n"), F.sum("_sum").alias("s"))
    )

    # Last segment that starts within one window after the bucket's cell.
    cell = X.floor_div(F.col("_bucket"), cfg.long_buckets)
    start_cell = X.floor_div(X.bucket(F.col("_time"), cfg), cfg.long_buckets)
    by_cell = Window.partitionBy(key).orderBy("cell")
    visible = (
        held.select(key, (cell + 1).alias("cell"), F.lit(None).cast("long").alias("seen_by"))
        .distinct()
        .unionByName(
            starts.groupBy(key, start_cell.alias("cell")).agg(F.max("_segment").alias("seen_by"))
        )
        .groupBy(key, "cell")
        .agg(F.max("seen_by").alias("seen_by"))
        .select(key, (F.col("cell") - 1).alias("cell"), F.max("seen_by").over(by_cell).alias("last"))
    )

    ordered = Window.partitionBy(key, "_bucket").orderBy("_segment")
    totals = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spread(held, rows, key, "_bucket")
        .select(
            key,
            "_bucket",
            cell.alias("cell"),
            (F.col("_segment") + 1).alias("first"),
            F.lead("_segment").over(ordered).alias("next"),
            F.sum("n").over(totals).alias("_n"),
            F.sum("s").over(totals).alias("_sum"),
        )
        .join(visible, [key, "cell"])
        .withColumn("last", F.least("next", "last"))
        .filter("first <= last")
        .select(
            key,
            F.explode(F.sequence("first", "last")).alias("_segment"),
            "_bucket",
            "_n",
            "_sum",
        )
    )

"""Expiry: what a row would still see if buckets behind the newest one were kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cardwatch.config import Config
from cardwatch.operators.segments import segmented, with_lateness_columns
from cardwatch.operators.windows import block_levels, block_of, cover

EXPIRY = ("oldest_bucket", "dropped_n", "dropped_amount")


def expired(
    tx: DataFrame, cfg: Config = Config(), key: str = "user_id", order: str = "arrival_seq"
) -> DataFrame:
    """Adds oldest_bucket, the oldest bucket that is still kept when a row arrives, and what
    that bound takes from the row's own window: accepted earlier rows, and their amount,
    that the window ending at the row's bucket holds but the store has dropped.

    Buckets are dropped by the newest bucket, windows end at the row's own. So only rows
    behind the newest bucket lose anything. Each of these asks for totals on blocks of 1,
    16 and 256 buckets; other rows add to the blocks that are asked. Totals run in arrival
    order per (user, block, segment of arrival), and per block over earlier segments, so
    neither a user nor a block has to fit into one task.
    """
    rows = with_lateness_columns(segmented(tx, cfg, key, order)[0], cfg, key, order).filter("_real")
    oldest = F.col("_run") - (cfg.long_buckets - 1)
    rows = rows.withColumn("oldest_bucket", oldest)
    levels = block_levels(cfg)
    # From the start of the row's window to the last dropped bucket in it.
    blocks = ", ".join(
        f"transform({nodes}, node -> named_struct('level', {w}, 'node', node))"
        for w, nodes in cover("_first", "_last", levels)
    )
    asks = (
        rows.filter("_bucket < _run")
        .withColumns(
            {
                "_first": F.col("_bucket") - (cfg.long_buckets - 1),
                "_last": F.least(F.col("_bucket"), F.col("oldest_bucket") - 1),
            }
        )
        .select(key, order, "_segment", F.inline(F.expr(f"concat({blocks})")).alias("_level", "_node"))
    )
    own = ", ".join(
        f"named_struct('level', {w}, 'node', {block_of('_bucket', w)})" for w in levels
    )
    adds = rows.filter("_held").select(
        key, order, "_segment", "_n", "_sum", F.inline(F.expr(f"array({own})")).alias("_level", "_node")
    )
    block = [key, "_level", "_node"]
    adds = adds.join(asks.select(*block).distinct(), block, "left_semi")

    earlier = Window.partitionBy(*block).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        adds.groupBy(*block, "_segment")
        .agg(F.sum("_n").alias("n"), F.sum("_sum").alias("s"))
        .unionByName(asks.select(*block, "_segment").distinct(), allowMissingColumns=True)
        .groupBy(*block, "_segment")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .select(
            *block, "_segment", F.sum("n").over(earlier).alias("_before_n"),
            F.sum("s").over(earlier).alias("_before_s"),
        )
    )
    # A row asks before it adds, so it is no part of its own answer.
    running = (
        Window.partitionBy(*block, "_segment")
        .orderBy(order, F.expr("_ask IS NULL"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    answers = (
        adds.unionByName(asks.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
        .withColumns({"_here_n": F.sum("_n").over(running), "_here_s": F.sum("_sum").over(running)})
        .filter("_ask")
        .join(before, [*block, "_segment"])
        .groupBy(key, order)
        .agg(
            F.sum(F.expr("coalesce(_here_n, 0) + coalesce(_before_n, 0)")).alias("dropped_n"),
            F.sum(F.expr("coalesce(_here_s, 0) + coalesce(_before_s, 0)")).alias("dropped_amount"),
        )
    )
    return rows.join(answers, [key, order], "left").select(
        *tx.columns,
        "oldest_bucket",
        F.coalesce("dropped_n", F.lit(0)).alias("dropped_n"),
        F.coalesce("dropped_amount", F.lit(0.0)).alias("dropped_amount"),
    )

"""Point-in-time window features per user, in event time and arrival order.

A row sees the accepted rows of its user that arrived before it and whose
100 ms bucket lies in the window that ends with the row's own bucket. Both
orders matter, because rows arrive late. Nothing here pairs rows with rows:

* Rows on time (nearly all): the running maximum bucket never falls with
  arrival. Sorted by it, a row's window is a range frame over rows that are all
  earlier arrivals, and the rows at its own place count up to its arrival. A frame
  holds a row for at most one window of buckets, so work per row is bounded.
  All totals are additions, so long histories lose no digits.
* Users with many rows a window: the part of the window that lies beyond the tolerance
  is as long as a block of buckets, so it is the end of one block and the beginning of
  the next. Both are running totals within their block, looked up by place: a few
  additions a row, however dense the rows.
* Late rows, and rows after a time at or before the epoch (for which lateness is
  not defined): counted on a tree of bucket blocks, with a running total in
  arrival order per block. Only segments that hold such rows take part.

Both use windows whose partitioning contains (user, segment): one shuffle in all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.config import Config
from cardwatch.operators.segments import segmented, with_lateness_columns

STORE_FEATURES = (
    "velocity_60s",
    "velocity_300s",
    "amount_sum_60s",
    "amount_sum_300s",
    "inter_arrival_ms",
    "oo_order_flag",
)
_FAN = 16


def with_lateness(
    tx: DataFrame, cfg: Config = Config(), key: str = "user_id", order: str = "arrival_seq"
) -> DataFrame:
    """Adds clamped time, bucket, running maxima, gap to the last row and late flags."""
    rows = with_lateness_columns(segmented(tx, cfg, key, order)[0], cfg, key, order)
    return (
        rows.filter("_real")
        .withColumns(_gap_and_flag())
        .withColumnsRenamed(
            {
                "_time": "time_ms",
                "_bucket": "bucket",
                "_prev": "prev_max_time_ms",
                "_run": "max_bucket_seen",
                "_late": "late",
                "_severe": "severe_late",
                "_held": "accepted",
            }
        )
        .drop("_segment", "_low", "_n", "_sum", "_real")
    )


def accepted(
    tx: DataFrame, cfg: Config = Config(), key: str = "user_id", order: str = "arrival_seq"
) -> DataFrame:
    """The rows that enter the history: all but the severely late."""
    return with_lateness(tx, cfg, key, order).filter("accepted")


def bucket_preagg(held: DataFrame, key: str = "user_id") -> DataFrame:
    """Count and amount per user and bucket of accepted rows."""
    return held.groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("amount").alias("amount_sum")
    )


def store_features(
    tx: DataFrame, cfg: Config = Config(), key: str = "user_id", order: str = "arrival_seq"
) -> DataFrame:
    """Adds the six history features to every row of `tx`, as of before the row itself."""
    rows, users = segmented(tx, cfg, key, order)
    rows = with_lateness_columns(rows, cfg, key, order)
    payload = [c for c in tx.columns if c not in (key, order)]
    wide_enough = min(cfg.short_buckets, cfg.long_buckets) >= cfg.late_buckets + 2
    fast = "_real AND _bucket = _run AND _low > 0" if wide_enough else "false"
    rows = rows.withColumn("_fast", F.expr(fast))
    parts = [_by_tree(rows, cfg, key, order, payload)]
    if wide_enough:
        sparse = rows
        if users.dense is not None:
            # A broadcast list: the rows stay where they are.
            dense = rows.join(users.dense, key, "left_semi")
            parts.append(_on_time(dense, cfg, key, order, payload, _settled_by_blocks))
            sparse = rows.join(users.dense, key, "left_anti")
        settled = _settled_by_blocks if users.all_dense else _settled_by_frames
        parts.append(_on_time(sparse, cfg, key, order, payload, settled))
    return reduce(
        DataFrame.unionByName, [part.select(*tx.columns, *STORE_FEATURES) for part in parts]
    )


def _gap_and_flag() -> dict[str, Column]:
    gap = "CASE WHEN _prev > 0 AND _time >= _prev THEN _time - _prev ELSE 0 END"
    return {
        "inter_arrival_ms": F.expr(gap).cast("double"),
        "oo_order_flag": F.col("_late").cast("double"),
    }


Settled = Callable[[DataFrame, Config, str], DataFrame]


def _on_time(
    rows: DataFrame, cfg: Config, key: str, order: str, payload: list[str], settled_by: Settled
) -> DataFrame:
    """Rows on time, by their running maximum bucket; `settled_by` adds the totals of what
    lies beyond the tolerance."""
    tolerance = cfg.late_buckets
    keep = [*payload, "inter_arrival_ms", "oo_order_flag", "_fast"]
    rows = rows.withColumns(_gap_and_flag())

    # An entry stands at a bucket and weighs in up to three ways: for rows at the
    # same place that arrive after it (0), for rows up to the tolerance further on
    # (1), and for rows beyond that (2).
    def entry(at: str, here: str, soon: str, settled: str, is_row: bool) -> str:
        weights = ", ".join(
            f"'n{i}', CASE WHEN {c} THEN _n END, 's{i}', CASE WHEN {c} THEN _sum END"
            for i, c in enumerate((here, soon, settled))
        )
        return f"named_struct('at', {at}, {weights}, 'is_row', {str(is_row).lower()})"

    on_time = "(_held AND _bucket = _run)"
    itself = entry("_run", "_held", on_time, on_time, True)
    # A late row stands at its own bucket for rows so far on that they came after
    # it; for nearer ones, at each place after the one where it arrived. There it
    # precedes all rows in arrival order.
    settled = entry("_bucket", "false", "false", "true", False)
    near = entry("at", "true", "false", "false", False)
    soon = (
        f"CASE WHEN _run < _bucket + {tolerance} THEN "
        f"transform(sequence(_run + 1, _bucket + {tolerance}), at -> {near}) ELSE array() END"
    )
    entries = F.expr(
        f"CASE WHEN _held AND _bucket < _run THEN concat(array({itself}, {settled}), {soon}) "
        f"ELSE array({itself}) END"
    )
    names = ("_at", "_n0", "_s0", "_n1", "_s1", "_n2", "_s2", "_is_row")
    # What only the row itself needs is not copied.
    exploded = rows.select(
        key, order, "_segment", *keep, F.inline(entries).alias(*names)
    ).selectExpr(
        key, order, "_segment", *names, *[f"CASE WHEN _is_row THEN {c} END AS {c}" for c in keep]
    )
    same = (
        Window.partitionBy(key, "_segment", "_at")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # The sort for `same` also serves this frame.
    by_place = Window.partitionBy(key, "_segment").orderBy("_at")
    soon_after = by_place.rangeBetween(-tolerance, -1)
    summed = exploded.withColumns(
        {"_here_n": F.sum("_n0").over(same), "_here_s": F.sum("_s0").over(same)}
    ).withColumns({"_soon_n": F.sum("_n1").over(soon_after), "_soon_s": F.sum("_s1").over(soon_after)})
    summed = settled_by(summed, cfg, key)

    def total(x: str, name: str) -> str:
        parts = (f"_here_{x}", f"_soon_{x}", f"_{x}{name}")
        return " + ".join(f"coalesce({part}, 0)" for part in parts)

    return summed.filter("_is_row AND _fast").selectExpr(
        key,
        order,
        *keep,
        *[f"CAST({total('n', name)} AS double) AS velocity_{name}" for name in ("60s", "300s")],
        *[f"{total('s', name)} AS amount_sum_{name}" for name in ("60s", "300s")],
    )


def _widths(cfg: Config) -> dict[str, int]:
    return {"60s": min(cfg.short_buckets, cfg.long_buckets), "300s": cfg.long_buckets}


def _settled_by_frames(entries: DataFrame, cfg: Config, key: str) -> DataFrame:
    """Totals beyond the tolerance, each by a frame over all entries of its window."""
    by_place = Window.partitionBy(key, "_segment").orderBy("_at")
    return entries.withColumns(
        {
            f"_{x}{name}": F.sum(f"_{x}2").over(
                by_place.rangeBetween(-(width - 1), -(cfg.late_buckets + 1))
            )
            for name, width in _widths(cfg).items()
            for x in ("n", "s")
        }
    )


def _settled_by_blocks(entries: DataFrame, cfg: Config, key: str) -> DataFrame:
    """The same totals from running totals within blocks.

    A window beyond the tolerance has as many places as a block. Unless it is a block, it
    begins in one and ends in the next: the total from its first place to the end of that
    block, and the total from the beginning of the next to its last place. Its first place
    is the last one at or after the window's start, read from the end; its last place the
    last one at or before the window's end. No frame holds more than a running total.
    """
    near = cfg.late_buckets + 1
    sizes = {name: width - near for name, width in _widths(cfg).items()}
    place = Window.partitionBy(key, "_segment")
    forward, backward = place.orderBy("_at"), place.orderBy(F.desc("_at"))
    for name, size in sizes.items():
        block = Window.partitionBy(key, "_segment", f"_block{name}")
        running = block.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
        remaining = block.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
        entries = (
            entries.withColumn(f"_block{name}", F.expr(block_of("_at", size)))
            .withColumns({f"_head_{x}{name}": F.sum(f"_{x}2").over(running) for x in ("n", "s")})
            .withColumns({f"_tail_{x}{name}": F.sum(f"_{x}2").over(remaining) for x in ("n", "s")})
        )
    heads = [f"_head_{x}{name}" for name in sizes for x in ("n", "s")]
    ended = F.last(F.struct("_at", *heads)).over(forward.rangeBetween(Window.unboundedPreceding, -near))
    entries = entries.withColumn("_ended", ended).withColumns(
        {
            f"_begun{name}": F.last(F.struct("_at", f"_tail_n{name}", f"_tail_s{name}")).over(
                backward.rangeBetween(Window.unboundedPreceding, width - 1)
            )
            for name, width in _widths(cfg).items()
        }
    )
    totals = {}
    for name, width in _widths(cfg).items():
        size = sizes[name]
        first, last = (block_of(at, size) for at in (f"_at - {width - 1}", f"_at - {near}"))
        for x in ("n", "s"):
            totals[f"_{x}{name}"] = F.expr(
                f"coalesce(CASE WHEN {block_of('_ended._at', size)} = {last} "
                f"THEN _ended._head_{x}{name} END, 0) + "
                f"coalesce(CASE WHEN {first} < {last} AND {block_of(f'_begun{name}._at', size)} = {first} "
                f"THEN _begun{name}._tail_{x}{name} END, 0)"
            )
    return entries.withColumns(totals)


def _by_tree(
    rows: DataFrame, cfg: Config, key: str, order: str, payload: list[str]
) -> DataFrame:
    """Rows not on time: totals on blocks of 1, 16, 256, ... buckets."""
    levels = block_levels(cfg)
    whole = (
        Window.partitionBy(key, "_segment")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    keep = [*payload, "inter_arrival_ms", "oo_order_flag"]
    rows = (
        rows.withColumns({**_gap_and_flag(), "_asks": F.expr("_real AND NOT _fast")})
        .withColumn("_asked", F.max("_asks").over(whole))
        .filter("_asked")
        .withColumn("_old300s", F.expr(f"_run - {cfg.long_buckets - 1}"))
        .withColumn("_old60s", F.expr(f"greatest(_bucket - {cfg.short_buckets - 1}, _old300s)"))
    )

    def block(level: int, node: str, n: str, s: str, ask: str) -> str:
        return (
            f"named_struct('level', {level}, 'node', {node}, 'n', {n}, 's', {s}, "
            f"'ask', CAST({ask} AS string))"
        )

    adds = [block(w, block_of("_bucket", w), "_n", "_sum", "NULL") for w in levels]
    asks = [f"array({block(0, '0L', '0L', '0D', repr('row'))})"] + [
        f"transform({nodes}, node -> {block(w, 'node', '0L', '0D', repr(name))})"
        for name in ("60s", "300s")
        for w, nodes in cover(f"_old{name}", "_bucket", levels)
    ]
    blocks = F.expr(
        f"concat(CASE WHEN _held THEN array({', '.join(adds)}) ELSE array() END, "
        f"CASE WHEN _asks THEN concat({', '.join(asks)}) ELSE array() END)"
    )
    entry = ("_level", "_node", "_in", "_is", "_ask")
    exploded = rows.select(key, order, "_segment", *keep, F.inline(blocks).alias(*entry)).selectExpr(
        key, order, "_segment", *entry, *[f"CASE WHEN _ask = 'row' THEN {c} END AS {c}" for c in keep]
    )

    # A row's questions sort before its own weight, so it does not see itself.
    seen = (
        Window.partitionBy(key, "_segment", "_level", "_node")
        .orderBy(order, F.expr("_ask IS NULL"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    mine = Window.partitionBy(key, "_segment", order)
    totals = {}
    for name in ("60s", "300s"):
        for total, source in ((f"velocity_{name}", "_seen_n"), (f"amount_sum_{name}", "_seen_s")):
            totals[total] = F.coalesce(
                F.sum(F.expr(f"CASE WHEN _ask = '{name}' THEN {source} END")).over(mine).cast("double"),
                F.lit(0.0),
            )
    return (
        exploded.withColumns({"_seen_n": F.sum("_in").over(seen), "_seen_s": F.sum("_is").over(seen)})
        .filter("_ask IS NOT NULL")
        .withColumns(totals)
        .filter("_ask = 'row'")
    )


def block_levels(cfg: Config) -> list[int]:
    """Lengths of blocks, in buckets: 1, 16, 256, ... up to a long window."""
    levels = [1]
    while levels[-1] * _FAN <= cfg.long_buckets:
        levels.append(levels[-1] * _FAN)
    return levels


def cover(lo: str, hi: str, levels: list[int]) -> list[tuple[int, str]]:
    """Blocks that together make up [lo, hi]: whole big ones first, then the edges."""

    def whole_blocks(w: int) -> tuple[str, str]:
        return block_of(f"{lo} + {w - 1}", w), f"{block_of(f'{hi} + 1', w)} - 1"

    out = []
    for i, w in enumerate(levels):
        first, last = whole_blocks(w)
        nodes = _span(first, last)
        if i + 1 < len(levels):
            big_first, big_last = whole_blocks(levels[i + 1])
            left = _span(first, f"({big_first}) * {_FAN} - 1")
            right = _span(f"({big_last} + 1) * {_FAN}", last)
            nodes = f"CASE WHEN {big_first} <= {big_last} THEN concat({left}, {right}) ELSE {nodes} END"
        out.append((w, nodes))
    return out


def _span(first: str, last: str) -> str:
    return f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE array() END"


def block_of(x: str, width: int) -> str:
    """SQL for the number of the block of that width; floors below zero too."""
    return f"(({x}) - pmod({x}, {width}L)) div {width}L"

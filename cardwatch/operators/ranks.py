"""Places of rows in an order, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.sinks import written


def with_positions(
    rows: DataFrame,
    order: Sequence[Column],
    name: str = "position",
    by: Sequence[str] = (),
    write: Callable[[DataFrame], DataFrame] = written,
) -> DataFrame:
    """Adds `name`: how many rows of the same group `by` precede the row in `order`.

    Rows are dealt out by ranges of (group, order), so a group of any size lies in as many
    tasks as its share asks for. They are written once by `write`, because ranges are drawn
    from a sample and must not move between uses. A place is the row's place in its task
    plus the group's rows in earlier tasks; those are counted per (task, group).
    """
    at, part, first, before = (_free(rows, c) for c in ("_at", "_part", "_first", "_before"))
    keys = [*map(F.col, by), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = write(dealt.withColumn(at, F.monotonically_increasing_id()))
    # The id of a row holds its task's number in the bits from 33 up.
    dealt = dealt.withColumn(part, F.shiftright(at, 33))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by, part)
        .agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
        .select(*by, part, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    )
    return (
        dealt.join(starts, [*by, part])
        .withColumn(name, F.col(at) - F.col(first) + F.col(before))
        .select(*rows.columns, name)
    )


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name = f"_{name}"
    return name

"""Shuffles with as many tasks as the rows ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows a task of a shuffle should hold: sorts and groups of so many stay below some 500 MB.
TASK_ROWS = 100_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt out by `keys` where `rows` of it ask for more tasks than shuffles have anyway."""
    tasks = -(-rows // TASK_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > usual else df

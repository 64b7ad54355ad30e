"""Written intermediate tables and row keys, used by several operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROW = "_row_key"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a folder in the warehouse, which they share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_written"
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """All columns and a row key, with the key's name: in the order of the ids.

    The key is the id where ids are unique, integer and never null. Elsewhere rows are
    written once with a number in the order (id, nulls first; text), so that rows which
    repeat an id are documents of their own.
    """
    key = ROW
    while key in docs.columns:
        key = f"_{key}"
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        repeated = docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
        if repeated.isEmpty():
            return docs.withColumn(key, F.col(id_col).cast("long")), key
    ordered = docs.repartitionByRange(id_col, text_col).sortWithinPartitions(id_col, text_col)
    return stage(ordered.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row key, _id, _text) of `numbered` rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return numbered(rows, "_id", "_text")[0].select(ROW, "_id", "_text")


def pieces(batch: Iterable[tuple], size: Iterable[int], limit: int) -> Iterator[list[tuple]]:
    """Cuts rows into lists of about `limit` bytes; a larger row stands alone."""
    block: list[tuple] = []
    total = 0
    for row, n in zip(batch, size, strict=True):
        if block and total + n > limit:
            yield block
            block, total = [], 0
        block.append(row)
        total += n
    if block:
        yield block


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )

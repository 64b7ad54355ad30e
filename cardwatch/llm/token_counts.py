"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cardwatch.llm.shared import pieces, stage
from cardwatch.llm.tokens import TokenizerFiles, encoder

#: Bytes of text encoded at a time.
BLOCK = 4_000_000
#: Lengths summed in one task; blocks of them are summed in another.
SPAN = 1024


def token_lengths(
    docs: DataFrame,
    *,
    text_col: str = "text",
    files: TokenizerFiles = TokenizerFiles(),
) -> DataFrame:
    """One row per document: n_tokens, without end marks. Null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["_text"].to_pylist()
            for block in pieces(texts, (len(t or "") for t in texts), BLOCK):
                counts = encoder(files).encode(block)[1]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    text = F.col(text_col).cast("string").alias("_text")
    return docs.select(text).mapInArrow(run, "n_tokens long")


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per distinct length L, with answers for a context limit of L tokens.

    n_docs: documents of that length; docs_longer, tokens_longer: those over the limit;
    docs_within: those that fit; total_tokens: of all documents; truncated_tokens: of
    all documents cut at L; share_within: the quantile at which L stands.

    Any other limit M between two rows follows from the row below it: documents over M
    are the same, so truncated(M) = truncated(L) + (M - L) * docs_longer.

    The histogram is one row per length, written once to the shared folder, as it is read
    twice. Sums run over blocks of lengths first, then
    within a block, so no task sees the whole of a large histogram.
    """
    hist = (
        stage(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
        .withColumn("block", F.floor(F.col("n_tokens") / SPAN))
        .withColumn("mass", F.col("n_docs") * F.col("n_tokens"))
    )
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    longer = (
        Window.partitionBy("block")
        .orderBy(F.desc("n_tokens"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    docs_longer = F.col("d_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    tokens_longer = F.col("t_above") + F.coalesce(F.sum("mass").over(longer), F.lit(0))
    return (
        hist.join(blocks, "block")
        .withColumn("docs_longer", docs_longer)
        .withColumn("tokens_longer", tokens_longer)
        .select(
            "n_tokens",
            "n_docs",
            "docs_longer",
            "tokens_longer",
            (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
            "total_tokens",
            (
                F.col("total_tokens") - F.col("tokens_longer")
                + F.col("n_tokens") * F.col("docs_longer")
            ).alias("truncated_tokens"),
            (1 - F.col("docs_longer") / F.col("all_docs")).alias("share_within"),
        )
    )


def token_counts(
    docs: DataFrame,
    *,
    text_col: str = "text",
    files: TokenizerFiles = TokenizerFiles(),
) -> DataFrame:
    """The length table of all documents: see length_table.

    Null and empty text: length 0. Ties and repeated rows count each. Empty table: no
    rows. Very long texts count whole. Other columns aren't read and can't clash.
    """
    return length_table(token_lengths(docs, text_col=text_col, files=files))

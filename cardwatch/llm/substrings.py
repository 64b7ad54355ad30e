"""Substring dedup: repeated windows of words, counted exactly by super-k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.minimisers import Block, Marks, Run, Windows, removed_ranges
from cardwatch.llm.shared import ROW, keyed

RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_text", pa.string()),
    ]
)
RESULT_DDL = (
    "struct<n_words: bigint, removed: array<struct<start: bigint, end: bigint>>, kept_text: string>"
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other bytes than space and tab to carriage return."""
    return (text or "").encode().split()


def split_words(rows: list[tuple[int, str | None]]) -> Block:
    flat, counts = [], np.empty(len(rows), np.int64)
    for k, (_, text) in enumerate(rows):
        words = words_of(text)
        counts[k] = len(words)
        if words:
            flat.append(b" ".join(words))
    data = b" ".join(flat)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    empty = not data
    starts = np.empty(0, np.int64) if empty else np.append(0, spaces + 1)
    ends = np.empty(0, np.int64) if empty else np.append(spaces, len(data))
    return Block([k for k, _ in rows], data, starts, ends, np.append(0, np.cumsum(counts)))


def later_windows(size: int):
    """Windows of words that occur earlier, by sorting all windows of the runs."""

    def resolve(runs: list[Run]) -> Marks:
        rows = []
        for run in runs:
            (key, unit), text = run.places[0], run.text
            spaces = [k for k, b in enumerate(text) if b == 32]
            starts, ends = [0, *(k + 1 for k in spaces)], [*spaces, len(text)]
            for i in range(run.windows):
                rows.append((text[starts[i] : ends[i + size - 1]], key, unit + i))
        rows.sort()
        return [(b[1], b[2], 1) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0]]

    return resolve


def _remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ranges in batches:
        found = []
        for text, own in zip(texts, ranges, strict=True):
            words = words_of(text.as_py())
            gone = np.zeros(len(words) + 1, np.int64)
            for r in own.as_py() or ():
                gone[r["start"]] += 1
                gone[r["end"]] -= 1
            gone = np.cumsum(gone) > 0
            edges = np.flatnonzero(np.diff(gone, prepend=False)).tolist()
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=False) if not g)
            found.append(
                {
                    "n_words": len(words),
                    "removed": [
                        {"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)
                    ],
                    "kept_text": kept.decode(),
                }
            )
        yield pa.array(found, RESULT)


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    gram: int = 5,
) -> DataFrame:
    """id_col, n_words, removed (ranges of words, end exclusive), kept_text.

    A word goes if a window of `window` words over it has the same words as one that
    starts earlier: in a row with a smaller id, or before it in the row. All windows are
    judged on the input. Kept words are joined by one space.

    Runs of windows with the same minimiser of `gram` words travel to its bucket as one
    string. Equal runs are put together there, and before they travel; where different
    runs share a minimiser, their windows are sorted and compared in full.

    Null text: no words. Texts shorter than a window are kept. Rows that repeat an id are
    documents of their own, in the order of (id, nulls first; text). Empty table: no rows.
    Very long texts are one document, up to 2 ** 28 words. Other columns aren't read.
    """
    rows = keyed(docs, id_col, text_col)
    gone = removed_ranges(
        rows.select(ROW, "_text"),
        Windows(window, gram, split_words),
        keep_first=True,
        resolve=later_windows(window),
    )
    # Hashing the ranges spares sorting the texts.
    gone = gone.withColumnRenamed("key", ROW).hint("shuffle_hash")
    joined = rows.join(gone, ROW, "left")
    remove = F.arrow_udf(_remove, RESULT_DDL)
    return joined.select(F.col("_id").alias(id_col), remove("_text", "ranges").alias("r")).select(
        id_col, "r.*"
    )


def n_removed() -> Column:
    return F.aggregate(
        "removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]
    )

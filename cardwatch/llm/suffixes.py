"""Suffix-array dedup: byte strings that occur twice, by difference-cover suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.minimisers import Block, Marks, Run, Windows, removed_ranges
from cardwatch.llm.shared import ROW, keyed

#: Bytes sorted in one suffix array; runs that share a minimiser are never parted.
SORTED = 1_000_000
#: Bytes of runs with one minimiser that are parted by a second one before they are sorted.
LARGE = 100_000

RESULT = pa.struct(
    [
        ("n_bytes", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)
RESULT_DDL = (
    "struct<n_bytes: bigint, removed: array<struct<start: bigint, end: bigint>>, kept: binary>"
)


def _names(*columns: np.ndarray) -> np.ndarray:
    """The rank, from 0, of each row of columns among the distinct rows."""
    rank = columns[0]
    for column in columns[1:]:
        rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * (int(column.max()) + 1) + column
    return np.unique(rank, return_inverse=True)[1]


def difference_cover_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of positive symbols, by the difference cover {1, 2} modulo 3.

    Suffixes at sampled places are named by their triples; while names repeat, the string
    of names is sorted by the same means. The others sort by their first symbol and the
    rank after it, and each finds its place among the sampled by a search for either kind.
    """
    n = len(symbols)
    if n < 4:
        whole = symbols.tolist()
        return np.array(sorted(range(n), key=lambda i: whole[i:]), np.int64)
    text = np.append(symbols, np.zeros(3, np.int64))
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sampled = np.append(ones, twos)
    names = _names(text[sampled], text[sampled + 1], text[sampled + 2])
    if names.max() + 1 == len(names):
        order = np.argsort(names)
    else:
        order = difference_cover_array(names + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    ordered = sampled[order]
    ordered = ordered[ordered < n]

    zeros = np.arange(0, n, 3)
    size = len(order) + 2
    key = text[zeros] * size + rank[zeros + 1]
    by_key = np.argsort(key)
    zeros, key = zeros[by_key], key[by_key]
    first = ordered[ordered % 3 == 1]
    second = ordered[ordered % 3 == 2]
    before = np.searchsorted(text[first] * size + rank[first + 1], key)
    both = np.append(zeros, second)
    pair = _names(text[both], text[both + 1]) * size + rank[both + 2]
    before += np.searchsorted(pair[len(zeros) :], pair[: len(zeros)])
    array = np.empty(n, np.int64)
    at = before + np.arange(len(zeros))
    rest = np.ones(n, bool)
    rest[at] = False
    array[at] = zeros
    array[rest] = ordered
    return array


def equal_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Which pairs of places have the same `size` bytes. The last bytes are compared first."""
    step = min(8, size)
    views = np.lib.stride_tricks.sliding_window_view(data, step)
    left = np.arange(len(a))
    for at in [size - step, *range(0, size - step, step)]:
        same = (views[a[left] + at] == views[b[left] + at]).all(axis=1)
        left = left[same]
        if not len(left):
            break
    found = np.zeros(len(a), bool)
    found[left] = True
    return found


def _repeated(runs: list[Run], size: int) -> Marks:
    lengths = np.array([len(r.text) for r in runs])
    windows = np.array([r.windows for r in runs])
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    data = np.frombuffer(b"\0".join(r.text for r in runs) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + len(runs) + 1
    symbols[ends - 1] = np.arange(1, len(runs) + 1)  # each end differs, so suffixes do
    array = difference_cover_array(symbols)
    own = np.searchsorted(ends, array, "right")
    whole = array - starts[own] < windows[own]
    near = np.flatnonzero(whole[:-1] & whole[1:])
    a, b = array[near], array[near + 1]
    same = equal_prefixes(data, a, b, size)
    twice = np.zeros(len(data) + 1, np.int8)
    twice[a[same]] = 1
    twice[b[same]] = 1
    edges = np.flatnonzero(np.diff(twice, prepend=0))
    begin, stop = edges[::2], edges[1::2]
    own = np.searchsorted(ends, begin, "right")
    offsets = (begin - starts[own]).tolist()
    counts = (stop - begin).tolist()
    return [
        (key, unit + o, n)
        for k, o, n in zip(own.tolist(), offsets, counts, strict=True)
        for key, unit in runs[k].places
    ]


def _together(groups: list[list[Run]], size: int) -> Marks:
    """Groups sorted in arrays of about SORTED bytes; a group is never parted."""
    marks: Marks = []
    batch: list[Run] = []
    total = 0
    for group in groups:
        batch += group
        total += sum(len(r.text) for r in group)
        if total > SORTED:
            marks += _repeated(batch, size)
            batch, total = [], 0
    return marks + (_repeated(batch, size) if batch else [])


def _parted(runs: list[Run], windows: Windows) -> Marks:
    """A large group, whose windows all share a minimiser, by a second one of each window.

    What the windows have around the common one parts nearly all of them.
    """
    lengths = [len(r.text) for r in runs]
    units = np.arange(sum(lengths))
    first = np.append(0, np.cumsum(lengths))
    block = Block([*range(len(runs))], b"".join(r.text for r in runs), units, units + 1, first)
    *columns, gram = windows.runs(block, turn=1)
    known: dict[bytes, Run] = {}
    for k, at, n, a, b, g in zip(*(c.tolist() for c in columns), gram.tolist(), strict=True):
        text = block.data[a:b]
        known.setdefault(text, Run(text, g, n, [])).places.append((k, at))
    groups: dict[int, list[Run]] = {}
    marks: Marks = []
    for part in known.values():
        groups.setdefault(part.gram, []).append(part)
        if len(part.places) > 1:
            marks += [(k, at, part.windows) for k, at in part.places]
    marks += _together([g for g in groups.values() if len(g) > 1], windows.size)
    return [
        (key, unit + at, n) for k, at, n in marks for key, unit in runs[k].places
    ]


def repeated_windows(windows: Windows):
    """Windows of bytes found twice in runs, which stand in order of their minimiser."""

    def resolve(runs: list[Run]) -> Marks:
        groups = [[*own] for _, own in groupby(runs, key=lambda r: r.gram)]
        marks, small = [], []
        for group in groups:
            if sum(len(r.text) for r in group) > LARGE:
                marks += _parted(group, windows)
            else:
                small.append(group)
        return marks + _together(small, windows.size)

    return resolve


def split_bytes(rows: list[tuple[int, str | None]]) -> Block:
    texts = [(t or "").encode() for _, t in rows]
    data = b"".join(texts)
    units = np.arange(len(data))
    first = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    return Block([k for k, _ in rows], data, units, units + 1, first)


def _remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ranges in batches:
        found = []
        for text, own in zip(texts, ranges, strict=True):
            data = (text.as_py() or "").encode()
            spans, kept, done = [], [], 0
            for a, b in sorted((r["start"], r["end"]) for r in own.as_py() or ()):
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], b)
                else:
                    spans.append({"start": a, "end": b})
            for s in spans:
                kept.append(data[done : s["start"]])
                done = s["end"]
            kept.append(data[done:])
            found.append({"n_bytes": len(data), "removed": spans, "kept": b"".join(kept)})
        yield pa.array(found, RESULT)


def dedup_suffixes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    gram: int = 32,
) -> DataFrame:
    """id_col, n_bytes, removed (maximal ranges of UTF-8 bytes, end exclusive), kept (bytes).

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the
    same row or another; the first occurrence goes as well. Strings are judged on the
    input, and don't cross rows.

    Suffixes whose first `length` bytes have the same minimiser meet in one bucket, with
    as much text as they need. Equal runs of them need no sorting; the rest of a bucket is
    sorted by difference covers, and neighbours in that order are compared.

    Null text: empty. Texts shorter than `length` stay. Rows that repeat an id are
    documents of their own. Empty table: no rows. Very long texts are one document, up to
    2 ** 28 bytes. What is kept may cut a character, so it is binary. Other columns aren't
    read.
    """
    rows = keyed(docs, id_col, text_col)
    windows = Windows(length, gram, split_bytes)
    gone = removed_ranges(
        rows.select(ROW, "_text"), windows, keep_first=False, resolve=repeated_windows(windows)
    )
    # Hashing the ranges spares sorting the texts.
    gone = gone.withColumnRenamed("key", ROW).hint("shuffle_hash")
    joined = rows.join(gone, ROW, "left")
    remove = F.arrow_udf(_remove, RESULT_DDL)
    return joined.select(F.col("_id").alias(id_col), remove("_text", "ranges").alias("r")).select(
        id_col, "r.*"
    )


"""Windows of a text grouped by minimiser and sent, packed, to buckets.

A minimiser is the m-gram with the least hash in a window. Windows with the same content
have the same minimiser, so they meet in one bucket; consecutive windows with the same
minimiser form a run, whose text travels once.

An m-gram is frequent if its hash falls in a class with many times its share of all
m-grams. Those rank behind all others, so that windows which only touch a frequent passage
go to buckets of their surroundings, and only windows wholly made of frequent m-grams
(copies, which are put together before they travel) use them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.shared import ROW, pieces, stage

CLASSES = 1 << 20
#: A class is frequent beyond so many times the mean; a task reports a class beyond half,
#: and not below LEAST.
FREQUENT, LEAST = 4, 4
#: Bytes of text worked on at a time, and bytes of packed runs meant for a bucket.
BLOCK, BUCKET = 1_000_000, 4_000_000

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
TOP = np.uint64(1 << 63)
#: Low bits of an ordering key that hold the place, so that of equal m-grams the first counts.
PLACE = np.uint64(28)
#: Bytes of text whose equal runs are put together before they travel.
TOGETHER = 8_000_000
#: Compression of packed runs.
LEVEL = 6


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK), np.uint64(base))
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of codes[start:end] for each span; equal spans have equal hashes."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


@dataclass
class Block:
    """Documents joined for numpy. Units are words or bytes; unit u covers data[start:end].

    first: number of each document's first unit, and the end.
    """

    keys: list[int]
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Windows:
    """How texts become units, and windows of `size` units with m-grams of `gram` units."""

    size: int
    gram: int
    split: Callable[[list[tuple[int, str | None]]], Block]

    def grams(self, block: Block) -> np.ndarray:
        codes = np.frombuffer(block.data, np.uint8)
        if self.gram >= len(block.starts):
            return np.empty(0, np.uint64)
        last = len(block.starts) - self.gram + 1
        return span_hashes(codes, block.starts[:last], block.ends[self.gram - 1 :])

    def runs(
        self, block: Block, frequent: np.ndarray | None = None, turn: int = 0
    ) -> tuple[np.ndarray, ...]:
        """(document, first unit in it, windows, first byte, end byte, minimiser hash).

        Each turn orders m-grams anew.
        """
        none = tuple(np.empty(0, np.int64) for _ in range(5)) + (np.empty(0, np.uint64),)
        counts = np.maximum(np.diff(block.first) - self.size + 1, 0)
        if not counts.any():
            return none
        hashes = self.grams(block)
        if len(hashes) >> int(PLACE):
            raise ValueError(f"a text has more than 2 ** {PLACE} words or bytes")
        ranks = mix(hashes + np.uint64(turn)) if turn else hashes
        keys = (ranks >> (PLACE + np.uint64(1)) << PLACE) | np.arange(len(hashes), dtype=np.uint64)
        if frequent is not None:
            keys[frequent[(hashes & np.uint64(CLASSES - 1)).astype(np.int64)]] |= TOP
        least = sliding_least(keys, self.size - self.gram + 1)
        at = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        document = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        inside = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        unit = block.first[:-1][document] + inside
        at = at[unit]
        new = np.ones(len(unit), bool)
        new[1:] = (at[1:] != at[:-1]) | (document[1:] != document[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(unit)))
        first = unit[begin]
        return (
            document[begin],
            inside[begin],
            length,
            block.starts[first],
            block.ends[first + length + self.size - 2],
            hashes[at[begin]],
        )


@dataclass(slots=True)
class Run:
    """A packed run: its text, 32 bits of its minimiser's hash, and where it occurs: (row
    key, unit)."""

    text: bytes
    gram: int
    windows: int
    places: list[tuple[int, int]]


#: (row key, first unit, number of windows): windows to remove.
Marks = list[tuple[int, int, int]]
Resolve = Callable[[list[Run]], Marks]

RANGES = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
#: Differences of row keys; first units; windows; bytes of text; minimisers.
RUN_FIELDS = tuple(map(np.dtype, ("<i8", "<u4", "<u2", "<u4", "<u4")))
RANGE_FIELDS = tuple(map(np.dtype, ("<i8", "<i8", "<i8")))


def pack_blob(fields: tuple[np.dtype, ...], columns: list, text: bytes = b"") -> bytes:
    arrays = [np.array(c, k) for c, k in zip(columns, fields, strict=True)]
    head = np.array([len(arrays[0])], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays) + text, LEVEL)


def unpack_blob(fields: tuple[np.dtype, ...], blob: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.decompress(blob)
    n, at, found = int(np.frombuffer(data[:8], "<i8")[0]), 8, []
    for kind in fields:
        found.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return found, data[at:]


def ranges(marks: Marks, size: int) -> list[np.ndarray]:
    """Marks as (row key, start, end) in units; those that touch in a row are joined."""
    key, start, count = np.array(sorted(marks), np.int64).reshape(-1, 3).T
    if not len(key):
        return [key, start, count]
    end = start + count + size - 1
    row = np.cumsum(np.append(0, key[1:] != key[:-1])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(row + end)
    new = np.append(True, (row + start)[1:] > reach[:-1])
    new[1:] |= key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    return [key[begin], start[begin], np.maximum.reduceat(end, begin)]


def frequent_classes(rows: DataFrame, windows: Windows) -> np.ndarray:
    """Which classes of m-grams are frequent, counted over all rows.

    A task reports classes beyond half of FREQUENT times its own mean. At most
    CLASSES / FREQUENT classes can be frequent, so what the driver gets is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for block in blocks(batch, windows):
                own = windows.grams(block) & np.uint64(CLASSES - 1)
                counts += np.bincount(own.astype(np.int64), minlength=CLASSES)
        total = int(counts.sum())
        some = np.flatnonzero(counts > max(FREQUENT * total / CLASSES / 2, LEAST))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(-1, some)), pa.array(np.append(total, counts[some]))], ["class", "n"]
        )

    counts = stage(
        rows.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")),
        "classes",
    )
    total = counts.filter("class < 0").first()
    found = np.zeros(CLASSES, bool)
    if total:
        limit = max(FREQUENT * total["n"] / CLASSES, LEAST)
        found[[r["class"] for r in counts.filter(f"class >= 0 and n > {limit}").collect()]] = True
    return found


def blocks(batch: pa.RecordBatch, windows: Windows) -> Iterator[Block]:
    pairs = list(zip(batch[ROW].to_pylist(), batch["_text"].to_pylist(), strict=True))
    for part in pieces(pairs, (len(t or "") for _, t in pairs), BLOCK):
        yield windows.split(part)


def _pack_runs(windows: Windows, frequent: np.ndarray, buckets: int, keep_first: bool):
    """Batches of rows -> packed runs and, of runs found equal here, what to remove."""
    schema = pa.schema([("bucket", pa.int64()), ("travels", pa.bool_()), ("blob", pa.binary())])

    def flush(known: dict[bytes, Run]) -> Iterator[pa.RecordBatch]:
        marks: Marks = []
        for run in known.values():
            if len(run.places) > 1:
                run.places.sort()
                rest = run.places[1:] if keep_first else run.places
                marks += [(key, unit, run.windows) for key, unit in rest]
        runs = sorted(known.values(), key=lambda r: r.gram % buckets)
        owners = np.array([r.gram % buckets for r in runs], np.int64)
        edges = np.flatnonzero(np.diff(owners, prepend=-1, append=-1))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = runs[a:b]
            columns = [
                np.diff([r.places[0][0] for r in own], prepend=0),
                [r.places[0][1] for r in own],
                [r.windows for r in own],
                [len(r.text) for r in own],
                [r.gram for r in own],
            ]
            blob = pack_blob(RUN_FIELDS, columns, b"".join(r.text for r in own))
            out.append({"bucket": int(owners[a]), "travels": True, "blob": blob})
        if marks:
            columns = ranges(marks, windows.size)
            bucket = int(columns[0][0]) % buckets
            blob = pack_blob(RANGE_FIELDS, columns)
            out.append({"bucket": bucket, "travels": False, "blob": blob})
        yield pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Run] = {}
        size = 0
        for batch in batches:
            for block in blocks(batch, windows):
                *columns, gram = windows.runs(block, frequent)
                columns = [c.tolist() for c in (*columns, gram & np.uint64(2**32 - 1))]
                for d, u, n, a, b, g in zip(*columns, strict=True):
                    text, place = block.data[a:b], (block.keys[d], u)
                    have = known.get(text)
                    if have:
                        have.places.append(place)
                    else:
                        known[text] = Run(text, g, n, [place])
                size += len(block.data)
                if size > TOGETHER:
                    yield from flush(known)
                    known, size = {}, 0
        if known:
            yield from flush(known)

    return run


def _resolve_bucket(windows: Windows, keep_first: bool, resolve: Resolve):
    """A bucket's blobs -> what to remove."""

    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, Run] = {}
        passed: list[list[np.ndarray]] = []
        for travels, blob in zip(table["travels"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if not travels:
                passed.append(unpack_blob(RANGE_FIELDS, blob)[0])
                continue
            columns, data = unpack_blob(RUN_FIELDS, blob)
            columns[0] = np.cumsum(columns[0])
            at = 0
            for key, unit, n, size, gram in zip(*(c.tolist() for c in columns), strict=True):
                text = data[at : at + size]
                at += size
                have = known.get(text)
                if have:
                    have.places.append((key, unit))
                else:
                    known[text] = Run(text, gram, n, [(key, unit)])
        marks: Marks = []
        by_gram: dict[int, list[Run]] = {}
        for run in known.values():
            by_gram.setdefault(run.gram, []).append(run)
            if len(run.places) > 1:
                run.places.sort()
                rest = run.places[1:] if keep_first else run.places
                marks += [(key, unit, run.windows) for key, unit in rest]
        marks += resolve([r for runs in by_gram.values() if len(runs) > 1 for r in runs])
        own = ranges(marks, windows.size)
        columns = [np.concatenate(c) for c in zip(own, *passed, strict=True)]
        return pa.table([pa.array(c) for c in columns], schema=RANGES)

    return run


def removed_ranges(
    rows: DataFrame, windows: Windows, *, keep_first: bool, resolve: Resolve
) -> DataFrame:
    """(key, ranges): for each row with any, the ranges of units under repeated windows.

    rows: row key and _text. keep_first: a window's first occurrence, by (key, unit), is
    not removed. resolve gets the distinct runs of a bucket that share a minimiser with
    another, and returns windows to remove; equal runs are dealt with before it.

    The number of buckets follows from the bytes of text, so a bucket's size does not grow.
    """
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(256, 3 * size // BUCKET)
    frequent = frequent_classes(rows, windows)
    packed = rows.mapInArrow(
        _pack_runs(windows, frequent, buckets, keep_first),
        "bucket long, travels boolean, blob binary",
    )
    found = packed.groupBy("bucket").applyInArrow(
        _resolve_bucket(windows, keep_first, resolve), "key long, start long, end long"
    )
    return found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

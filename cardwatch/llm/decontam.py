"""Benchmark decontamination: benchmark suffixes looked up in suffix arrays of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.shared import numbered, pieces, stage

#: Bytes of text in one shard, that is in one suffix array; a longer text has its own.
SHARD = 4_000_000
#: Bytes of benchmark text broadcast at a time; more is worked off block after block.
BLOCK = 32_000_000
#: Windows searched at once, which bounds memory.
TOGETHER = 50_000

#: Lower-cases A-Z; what is no word character becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
RESULT_DDL = "n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Probe:
    """A block of benchmark items, as numbers of words, and its distinct windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.names = [name for name, _ in items]
        self.words = [np.array([*map(number, words_of(t))], np.int64) for _, t in items]
        self.windows: dict[bytes, set[int]] = {}
        for k, words in enumerate(self.words):
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.windows.setdefault(words[i : i + size].tobytes(), set()).add(k)
        self.shortest = min((len(w) // 8 for w in self.windows), default=0)
        self.longest = max(map(len, self.words), default=0)


@dataclass
class Shard:
    """Documents that share a suffix array.

    Only runs of benchmark words can match; runs shorter than the shortest window can't
    hold one. The array is built over the other runs, with 0 between them.
    """

    text: np.ndarray
    place: np.ndarray
    array: np.ndarray
    first: np.ndarray
    total: int

    @classmethod
    def build(cls, texts: list[str | None], probe: Probe, shortest: int, depth: int) -> Shard:
        words: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = words_of(text)
            counts[k] = len(own)
            words += own
        first = np.append(0, np.cumsum(counts))
        codes = np.fromiter(map(probe.vocabulary.get, words, repeat(0)), np.int64, len(words))
        breaks = np.zeros(len(codes) + 1, bool)
        breaks[first] = True
        breaks[:-1] |= codes == 0
        breaks[1:] |= codes == 0
        edges = np.flatnonzero(breaks)
        sizes = np.diff(edges)
        good = (sizes >= max(shortest, 1)) & (codes[edges[:-1]] > 0) if len(edges) > 1 else []
        starts, sizes = edges[:-1][good], sizes[good] + 1  # a separator after each run
        ends = np.cumsum(sizes)
        place = np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())
        text = np.append(codes, 0)[np.minimum(place, len(codes))]
        text[ends - 1] = 0
        return cls(text, place, suffix_array(text, depth), first, len(codes))

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `text` in the order of what starts there, to `depth` symbols, by
    doubling; positions of 0 are left out."""
    if not len(text):
        return np.empty(0, np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        ahead = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
        values, new = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)
        rank = new.astype(np.int64)
        if len(values) == len(rank):
            break
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[text[order] > 0]


def bounds(shard: Shard, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the range of suffixes that begin with the first sizes[q] symbols of
    each row of `queries`."""
    if len(queries) > TOGETHER:
        parts = [
            bounds(shard, queries[k : k + TOGETHER], sizes[k : k + TOGETHER])
            for k in range(0, len(queries), TOGETHER)
        ]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    width = queries.shape[1]
    padded = np.append(shard.text, np.zeros(width, np.int64))
    inside = np.arange(width) < sizes[:, None]

    def search(after_equal: bool) -> np.ndarray:
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), len(shard.array))
        while (active := low < high).any():
            middle = np.where(active, (low + high) // 2, 0)
            found = padded[shard.array[middle][:, None] + np.arange(width)]
            differs = (found != queries) & inside
            at = differs.argmax(axis=1)
            rows = np.arange(len(queries))
            equal = ~differs[rows, at]
            less = np.where(equal, after_equal, found[rows, at] < queries[rows, at])
            low = np.where(active & less, middle + 1, low)
            high = np.where(active & ~less, middle, high)
        return low

    if not len(shard.array) or not len(queries):
        nothing = np.zeros(len(queries), np.int64)
        return nothing, nothing
    return search(False), search(True)


def _queries(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    table = np.zeros((len(rows), int(sizes.max(initial=1))), np.int64)
    for k, r in enumerate(rows):
        table[k, : len(r)] = r
    return table, sizes


def _hits(texts: list[str | None], probe: Probe) -> list[dict]:
    shard = Shard.build(texts, probe, probe.shortest, min(probe.longest, 1 << 20))
    windows = [np.frombuffer(w, np.int64) for w in probe.windows]
    low, high = bounds(shard, *_queries(windows))
    change = np.zeros(shard.total + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for k, owners in enumerate(probe.windows.values()):
        if low[k] < high[k]:
            at = shard.place[shard.array[low[k] : high[k]]]
            np.add.at(change, at, 1)
            np.add.at(change, at + len(windows[k]), -1)
            for d in np.unique(shard.documents(at)).tolist():
                items[d] |= owners
    hit = np.append(np.cumsum(change[:-1]) > 0, False)
    found = []
    for d in range(len(texts)):
        own = hit[shard.first[d] : shard.first[d + 1]]
        edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
        spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        names = sorted({probe.names[i] for i in items[d]})
        found.append({"n_words": len(own), "spans": spans, "items": names})
    return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Distinct items in blocks that fit a broadcast. Null ids: the empty name."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name")
    items = stage(benchmark.select(name, F.col(text_col).alias("text")).distinct(), "items")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    count = 1 if size <= limit else 2 * size // limit + 1
    block = F.pmod(F.xxhash64("name", "text"), F.lit(count))
    for k in range(count):
        yield [tuple(r) for r in items.filter(block == k).collect()]


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    out: str = "contamination",
    limit: int = BLOCK,
) -> DataFrame:
    """Appends a struct (a column named `out` is replaced): n_words, spans (word positions
    inside any occurrence of a window, end exclusive), items (names of those with windows
    that occur, as sorted strings).

    A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one. Documents are cut into shards of SHARD bytes, each with a suffix array
    over its words; all windows are binary-searched in each. Benchmark text is broadcast
    up to `limit` bytes; beyond it, block after block goes over all documents, each
    written, and the results are put together.

    Null text: no words. Null item ids: the empty name. Repeated items, ids and rows each
    count as they are. Empty tables: nothing found. Very long texts are searched whole.
    """
    docs = docs.drop(out)
    spark = docs.sparkSession

    def search(block: list[tuple]) -> Column:
        sent = spark.sparkContext.broadcast(block)
        state: dict[str, Probe] = {}

        @F.arrow_udf(f"struct<{RESULT_DDL}>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            probe = state.setdefault("probe", Probe(sent.value, window))
            for batch in batches:
                texts = batch.to_pylist()
                found: list[dict] = []
                for shard in pieces(texts, (len(t or "") for t in texts), SHARD):
                    found += _hits(shard, probe)
                yield pa.array(found, RESULT)

        return run(F.col(text_col).cast("string"))

    blocks = _blocks(benchmark, item_id_col, item_text_col, limit)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(out, search(first))
    rows, key = numbered(docs, id_col, text_col)
    parts = [
        stage(rows.select(key, search(block).alias("_found")), "found")
        for block in (first, second, *blocks)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy(key).agg(
        F.struct(
            F.max("_found.n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("_found.spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found.items")))).alias("items"),
        ).alias(out)
    )
    return rows.join(merged, key).drop(key)


def n_hit(out: str = "contamination") -> Column:
    """Words under any span."""
    return F.aggregate(
        F.col(out)["spans"],
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any window of the benchmark, with their own columns.

    options and cases as in `with_contamination`: a null or empty text holds no window and
    stays, so do all documents if the benchmark is empty. Columns of any name stay as they are.
    """
    out = "_contamination"
    while out in docs.columns:
        out = f"_{out}"
    marked = with_contamination(docs, benchmark, out=out, **options)
    return marked.filter(F.size(F.col(out)["items"]) == 0).select(*[f"`{c}`" for c in docs.columns])


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 5,
    limit: int = BLOCK,
) -> DataFrame:
    """For every benchmark suffix with a match of `least` or more words: item, start, the
    longest verbatim match `length`, and a place of it: doc (id as a string), doc_start.

    Each shard reports its own longest match of a suffix (at most one row per suffix and
    shard); an aggregate takes the longest of all, of ties the smallest doc_start. The suffix
    is compared with its two neighbours in the shard's suffix array.
    """
    spark = docs.sparkSession
    ddl = "item string, start long, length long, doc string, doc_start long"
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    found = None
    for block in _blocks(benchmark, item_id_col, item_text_col, limit):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            probe = Probe(sent.value, 1)
            suffixes = [w[i:] for w in probe.words for i in range(len(w))]
            names = [(n, i) for n, w in zip(probe.names, probe.words, strict=True) for i in range(len(w))]
            table, sizes = _queries(suffixes)
            for batch in batches:
                pairs = list(zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True))
                for part in pieces(pairs, (len(t or "") for _, t in pairs), SHARD):
                    shard = Shard.build([t for _, t in part], probe, least, probe.longest)
                    if not len(shard.array) or not suffixes:
                        continue
                    low = bounds(shard, table, sizes)[0]
                    # The insertion point's two neighbours share the longest prefixes.
                    padded = np.append(shard.text, np.zeros(table.shape[1], np.int64))
                    best, at = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
                    for near in (low - 1, low):
                        there = shard.array[np.clip(near, 0, len(shard.array) - 1)]
                        text = padded[there[:, None] + np.arange(table.shape[1])]
                        same = (text == table) & (table > 0)
                        length = np.where(same.all(axis=1), sizes, (~same).argmax(axis=1))
                        at = np.where(length > best, there, at)
                        best = np.maximum(best, length)
                    keep = np.flatnonzero(best >= least)
                    place = shard.place[at[keep]]
                    docs_at = shard.documents(place)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item": [names[k][0] for k in keep],
                            "start": [names[k][1] for k in keep],
                            "length": best[keep],
                            "doc": pa.array([part[d][0] for d in docs_at], pa.string()),
                            "doc_start": place - shard.first[docs_at],
                        }
                    )

        part = rows.mapInArrow(run, ddl)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("length", (-F.col("doc_start")).alias("s"), "doc")).alias("b")
    return (
        found.groupBy("item", "start")
        .agg(best)
        .select("item", "start", "b.length", "b.doc", (-F.col("b.s")).alias("doc_start"))
    )

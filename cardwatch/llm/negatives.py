"""Hard negatives of anchors, by bounds along spanning trees of the anchors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.llm.shared import ROW, numbered, stage
from cardwatch.operators.ranks import with_positions

#: Anchors of one tree, and bytes of anchors that go to the tasks at a time.
TREE, CHUNK_BYTES = 256, 16_000_000
#: Candidates scored at a time.
SLICE = 10_000
#: Share of a slice from which all its scores are computed at once.
DENSE = 0.25
#: Largest magnitude of a scaled component.
LARGEST = 2**31 - 1
#: Stands for no score; its negative is a number too.
_LOWEST = 1 - 2**63

VECTOR = f"{ROW} long, _label long, _v binary, _size int"


def _whole(scale: int):
    """floor(scale * x) of each vector as little-endian 32-bit numbers; null where a row
    takes no part."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            out = []
            for vector in vectors:
                own = vector.values
                if not vector.is_valid or own.null_count:
                    out.append(None)
                    continue
                x = own.to_numpy(zero_copy_only=False).astype("f8")
                if not np.isfinite(x).all():
                    out.append(None)
                    continue
                x = np.floor(scale * x)
                if (np.abs(x) > LARGEST).any():
                    raise ValueError(f"a component times {scale} is beyond {LARGEST}")
                out.append(x.astype("<i4").tobytes())
            yield pa.array(out, pa.binary())

    return run


def _matrix(raw: list[bytes], size: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    return np.frombuffer(b"".join(r.ljust(4 * size, b"\0") for r in raw), "<i4").reshape(-1, size)


def _code(bits: int = 16):
    """Signs of a vector's products with fixed random directions."""

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            raw = vectors.to_pylist()
            size = max((len(r) // 4 for r in raw), default=0)
            directions = np.random.default_rng(12).normal(size=(bits, size)).T
            signs = _matrix(raw, size) @ directions > 0 if size else np.zeros((len(raw), bits), bool)
            yield pa.array(signs @ (1 << np.arange(bits)), pa.int32())

    return run


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree from row 0: rows in the order they join, parents, edge lengths."""
    n, x = len(vectors), vectors.astype("f8")
    norm = (x * x).sum(axis=1)
    order, parent = np.zeros(n, np.int32), np.zeros(n, np.int32)
    near, link = np.full(n, np.inf), np.zeros(n, np.int32)
    now = 0
    for k in range(n):
        order[k], parent[k] = now, link[now]
        near[now] = -np.inf
        apart = np.maximum(norm + norm[now] - 2 * (x @ x[now]), 0)
        closer = (apart < near) & (near > -np.inf)
        near[closer], link[closer] = apart[closer], now
        left = np.where(near > -np.inf, near, np.inf)
        now = int(left.argmin())
    return order, parent, np.sqrt(((x[order] - x[parent]) ** 2).sum(axis=1)) * (np.arange(n) > 0)


def _grow(batches: pa.Table) -> pa.Table:
    """The anchors of one tree, parents before children, with parent's place and edge."""
    rows = batches.sort_by("_place")
    vectors = _matrix(rows["_v"].to_pylist(), max(rows["_size"].to_pylist(), default=0))
    order, parent, edge = spanning_tree(vectors)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    grown = rows.take(pa.array(order)).drop_columns(["_place"])
    return grown.append_column("at", pa.array(np.arange(len(order), dtype=np.int32))).append_column(
        "parent", pa.array(place[parent].astype(np.int32))
    ).append_column("edge", pa.array(edge))


class Tree:
    """Anchors of one label; scores of candidates are bounded from parent to child."""

    def __init__(self, keys: list[int], label: int, raw: list[bytes], parent: list[int], edge: list[float]):
        self.keys, self.label, self.parent = np.array(keys, np.int64), label, parent
        self.vectors = _matrix(raw, max(len(r) // 4 for r in raw))
        # Distances are rounded; scores are whole, so a margin of one is cheap.
        self.edge = np.array(edge) * (1 + 1e-9)

    def scores(self, candidates: Slice, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor's place, candidates rescored, their scores) along the tree.

        The parent's score, or its bounds where it wasn't rescored, plus or minus the edge
        times the candidate's norm bounds the child's score. wanted(place, low, high) says
        which candidates can matter; only these are rescored.
        """
        n, k = len(candidates.norm), len(self.keys)
        if not n:
            return
        own, bounded = candidates.exact(self.vectors)
        low, high = np.empty((k, n)), np.empty((k, n))
        for at in range(k):
            if at and bounded:
                reach = self.edge[at] * candidates.norm + 1
                np.subtract(low[self.parent[at]], reach, out=low[at])
                np.add(high[self.parent[at]], reach, out=high[at])
            else:
                low[at], high[at] = -np.inf, np.inf
            some = wanted(at, low[at], high[at])
            idx = np.arange(n) if at == 0 else np.flatnonzero(some)
            if not len(idx):
                continue
            score = own(at, idx)
            low[at, idx] = high[at, idx] = score
            keep = some[idx]
            yield at, idx[keep], score[keep]


class Slice:
    """Candidates with their norms; scores are exact whole numbers."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.keys, self.labels, self.vectors = keys, labels, vectors
        self.norm = np.sqrt((vectors.astype("f8") ** 2).sum(axis=1)) * (1 + 1e-9)

    def part(self, mask: np.ndarray) -> Slice:
        out = object.__new__(Slice)
        out.keys, out.labels = self.keys[mask], self.labels[mask]
        out.vectors, out.norm = self.vectors[mask], self.norm[mask]
        return out

    def exact(self, anchors: np.ndarray):
        """A function of (anchor's place, candidates) that gives their scores, and whether
        doubles hold them.

        They hold every partial sum where the product of the norms stays below 2 ** 53;
        else whole numbers of any length are used, and no bounds.
        """
        size = min(anchors.shape[1], self.vectors.shape[1])
        a, c = anchors[:, :size], self.vectors[:, :size]
        most = np.sqrt((a.astype("f8") ** 2).sum(axis=1).max(initial=0)) * self.norm.max(initial=0)
        kind = "f8" if most < 2**53 else object
        a, c = a.astype(kind), c.astype(kind)

        def run(at: int, idx: np.ndarray) -> np.ndarray:
            if len(idx) > DENSE * len(c):
                return (c @ a[at])[idx].astype(np.int64)
            return (c[idx] @ a[at]).astype(np.int64)

        return run, kind == "f8"


class Best:
    """The first k (score, key) of each slot, higher scores first, then smaller keys."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _LOWEST, np.int64)
        self.key = np.full((slots, k), 2**63 - 1, np.int64)

    def least(self, slot: int) -> int:
        """A score below this one can't enter."""
        return int(self.score[slot, -1])

    def add(self, slot: int, score: np.ndarray, key: np.ndarray) -> None:
        some = score >= self.score[slot, -1]
        if some.any():
            score = np.concatenate((self.score[slot], score[some]))
            key = np.concatenate((self.key[slot], key[some]))
            first = np.lexsort((key, -score))[: self.k]
            self.score[slot], self.key[slot] = score[first], key[first]

    def found(self, slot: int) -> list[tuple[int, int]]:
        return [
            (s, c)
            for s, c in zip(self.score[slot].tolist(), self.key[slot].tolist(), strict=True)
            if s > _LOWEST
        ]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            size = max(part["_size"].to_pylist(), default=0)
            yield Slice(
                part[ROW].to_numpy(), part["_label"].to_numpy(), _matrix(part["_v"].to_pylist(), size)
            )


def _emit(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["anchor", "score", "other"]
    )


def _positives(trees: list[Tree], k: int):
    """Batches of candidates -> the task's first k rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(t.keys), k) for t in trees]
        for block in _slices(batches):
            by_label: dict[int, Slice] = {}
            for tree, own in zip(trees, best, strict=True):
                if tree.label not in by_label:
                    by_label[tree.label] = block.part(block.labels == tree.label)
                mates = by_label[tree.label]

                def wanted(at: int, low: np.ndarray, high: np.ndarray, own=own) -> np.ndarray:
                    return high >= own.least(at)

                for at, idx, score in tree.scores(mates, wanted):
                    keys = mates.keys[idx]
                    other = keys != tree.keys[at]
                    own.add(at, score[other], keys[other])
        yield _emit(
            [
                (int(key), s, c)
                for tree, own in zip(trees, best, strict=True)
                for at, key in enumerate(tree.keys)
                for s, c in own.found(at)
            ]
        )

    return run


def _negatives(trees: list[Tree], windows: dict[int, list[tuple[int, int]]], k: int):
    """Batches of candidates -> rows among the task's first k of any window of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = [[windows.get(int(key), []) for key in t.keys] for t in trees]
        best = [[Best(len(own), k) for own in s] for s in spans]
        for block in _slices(batches):
            by_label: dict[int, Slice] = {}
            for tree, span, own in zip(trees, spans, best, strict=True):
                if not any(span):
                    continue
                if tree.label not in by_label:
                    by_label[tree.label] = block.part(block.labels != tree.label)
                others = by_label[tree.label]

                def wanted(at: int, low: np.ndarray, high: np.ndarray, span=span, own=own) -> np.ndarray:
                    if not span[at]:
                        return np.zeros(len(low), bool)
                    bottom = min(max(a, own[at].least(i)) for i, (a, _) in enumerate(span[at]))
                    return (high >= bottom) & (low <= max(b for _, b in span[at]))

                for at, idx, score in tree.scores(others, wanted):
                    for i, (a, b) in enumerate(span[at]):
                        inside = (score >= a) & (score <= b)
                        own[at].add(i, score[inside], others.keys[idx[inside]])
        yield _emit(
            [
                (int(key), s, c)
                for tree, own in zip(trees, best, strict=True)
                for at, key in enumerate(tree.keys)
                for s, c in {x for i in range(len(own[at].score)) for x in own[at].found(i)}
            ]
        )

    return run


def _windows(positives: DataFrame, percent: tuple[int, int]) -> DataFrame:
    """Whole scores that lie in the window of a positive: from `low` to `high`."""
    part = "CAST(positive_score AS decimal(20, 0)) * {} / 100"
    whole = "coalesce(try_cast({} AS bigint), {})"
    least, most = (part.format(p) for p in percent)
    return positives.withColumns(
        {
            "low": F.expr(whole.format(f"ceil({least})", "9223372036854775807L")),
            "high": F.expr(whole.format(f"floor({most})", "9223372036854775807L")),
        }
    )


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    A component becomes floor(scale * x), a score is the inner product with the anchor. An
    anchor's positives are its first `n_positives` other rows of its label; the negatives of
    a positive are the first `n_negatives` rows of other labels whose score is between
    `percent[0]` and `percent[1]` percent of the positive's. Higher scores come first, then
    smaller ids.

    Anchors are ordered by label and by signs along random directions and cut into trees of
    at most 256, each a minimum spanning tree. In a block of candidates, the root's scores
    are computed; along an edge, a score moves by at most the edge's length times the
    candidate's norm. That bounds each child's score, and only candidates whose bounds meet
    the child's window are rescored (those of the best so far, for positives). Results are exact.

    All anchors go over all rows, in chunks of 16 MB of anchors: each chunk reads the vectors
    twice, once for positives and once for negatives. A task returns its first few rows of
    each anchor or window; these are ranked by anchor. No label is gathered anywhere.

    Null labels, vectors or ids, and vectors with null or non-finite components: no part.
    Vectors of unequal length: the shorter ends in zeros. Empty vectors: score 0. Ties and
    repeated rows: rows of their own; of the same id, in a fixed order by vector. Empty
    table, or no anchors: no rows. Other columns aren't read and can't clash. A scaled
    component beyond 32 bits raises an error, as does a score beyond 64 bits.
    """
    named = rows.select(
        F.col(id_col).alias("_id"),
        F.col(label_col).cast("long").alias("_label"),
        F.col(vector_col).alias("_vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"),
    )
    named = named.filter("_id IS NOT NULL AND _label IS NOT NULL AND _vector IS NOT NULL")
    keyed, key = numbered(named, "_id", "_vector")
    whole = keyed.select(
        F.col(key).alias(ROW), "_id", "_label", "_anchor", _whole(scale)("_vector").alias("_v")
    )
    whole = stage(
        whole.filter("_v IS NOT NULL").withColumn("_size", F.expr("int(length(_v) div 4)")), "vectors"
    )
    vectors = whole.select(ROW, "_label", "_v", "_size")

    anchors = whole.filter("_anchor").select(ROW, "_label", "_v", "_size")
    order = [F.col("_code"), F.col(ROW)]
    placed = with_positions(
        anchors.withColumn("_code", _code()("_v")), order, "_place", by=["_label"],
        write=lambda df: stage(df, "anchors"),
    )
    placed = placed.drop("_code").withColumn("tree", F.expr(f"_place div {TREE}"))
    schema = f"{VECTOR}, tree long, at int, parent int, edge double"
    grown = stage(placed.groupBy("_label", "tree").applyInArrow(_grow, schema), "trees")

    # Trees are dealt to chunks by a running total of their bytes.
    sizes = grown.groupBy("_label", "tree").agg(F.sum(F.length("_v") + 64).alias("bytes"))
    running = Window.orderBy("_label", "tree").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(running), F.lit(0))
    chunks = sizes.select("_label", "tree", (before / CHUNK_BYTES).cast("long").alias("chunk"))
    dealt = stage(grown.join(chunks, ["_label", "tree"]), "chunks")
    n_chunks = (dealt.agg(F.max("chunk")).first()[0] or 0) + 1

    found = []
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    for chunk in range(n_chunks):
        trees = _trees(dealt.filter(F.col("chunk") == chunk))
        if not trees:
            continue
        ddl = "anchor long, score long, other long"
        mates = vectors.mapInArrow(_positives(trees, n_positives), ddl)
        mates = mates.withColumn("nth", F.row_number().over(first)).filter(f"nth <= {n_positives}")
        mates = _windows(
            mates.select("anchor", F.col("other").alias("positive"), F.col("score").alias("positive_score")),
            percent,
        )
        mates = stage(mates, "positives")
        windows: dict[int, list[tuple[int, int]]] = {}
        spans = mates.filter("low <= high").select("anchor", "low", "high").toArrow()
        for anchor, low, high in zip(*(c.to_pylist() for c in spans.columns), strict=True):
            windows.setdefault(anchor, []).append((low, high))
        near = vectors.mapInArrow(_negatives(trees, windows, n_negatives), ddl)
        near = stage(near, "negatives")
        each = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
        hard = (
            mates.join(near, "anchor")
            .filter("score BETWEEN low AND high")
            .withColumn("rank", F.row_number().over(each))
            .filter(f"rank <= {n_negatives}")
        )
        found.append(stage(hard.drop("low", "high"), "hard"))
    if not found:
        kind = dict(named.dtypes)["_id"]
        ddl = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}"
        return rows.sparkSession.createDataFrame([], f"{ddl}, positive_score long, negative_score long")
    hard = reduce(DataFrame.unionByName, found)
    names = whole.select(ROW, "_id")
    for column, name in (("anchor", "anchor_id"), ("positive", "positive_id"), ("other", "negative_id")):
        hard = hard.join(names.select(F.col(ROW).alias(column), F.col("_id").alias(name)), column)
    return hard.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        F.col("score").alias("negative_score"),
    )


def _trees(chunk: DataFrame) -> list[Tree]:
    """The chunk's trees; a chunk has at most about CHUNK_BYTES."""
    rows: dict[tuple[int, int], list] = {}
    for r in chunk.collect():
        rows.setdefault((r["_label"], r["tree"]), []).append(r)
    out = []
    for (label, _), own in sorted(rows.items()):
        own.sort(key=lambda r: r["at"])
        raw = [bytes(r["_v"]) for r in own]
        out.append(Tree([r[ROW] for r in own], label, raw, [r["parent"] for r in own], [r["edge"] for r in own]))
    return out

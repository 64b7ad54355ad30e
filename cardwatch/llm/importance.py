"""Target-distribution importance resampling: exact weights from planes of bits."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.shared import ROW, keyed, numbered, pieces, stage
from cardwatch.operators.ranks import with_positions

#: Bytes of text, and documents, whose planes are made at a time.
BLOCK, DOCS = 4_000_000, 512
#: Features whose buckets a task remembers.
REMEMBERED = 500_000

# Letters, digits and all bytes of other scripts stay; A-Z become small, the rest spaces.
_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


def features_of(words: list[bytes], runs: tuple[int, int]) -> list[bytes]:
    """All runs of `runs[0]` to `runs[1]` consecutive words."""
    if runs == (1, 1):
        return words
    return [
        b" ".join(words[i : i + n])
        for n in range(runs[0], runs[1] + 1)
        for i in range(len(words) - n + 1)
    ]


class _Buckets(dict):
    """Feature -> bucket, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = found
        return found


def plane_bytes(buckets: int) -> int:
    """Bytes of a plane: a bit for each bucket, in whole words of 64 bits."""
    return -(-buckets // 64) * 8


def to_planes(owner: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, width: int):
    """Planes of n owners from distinct (owner, bucket) with counts.

    Plane i of an owner has the bits of the buckets whose count has bit i. Returns the
    bytes of all planes, one after another, and each owner's first plane with the end.
    """
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, count)
    first = np.concatenate(([0], np.cumsum(np.frexp(top.astype(float))[1]))).astype(np.int64)
    out = np.zeros(int(first[-1]) * width, np.uint8)
    for i in range(int(np.diff(first).max(initial=0))):
        has = (count >> i & 1).astype(bool)
        at = (first[owner[has]] + i) * width + (bucket[has] >> 3)
        places, inverse = np.unique(at, return_inverse=True)
        out[places] = np.bincount(inverse, 1 << (bucket[has] & 7)).astype(np.uint8)
    return out.tobytes(), first


class Gains:
    """Gains of the buckets as planes of bits of their magnitudes, one set for each sign."""

    def __init__(self, gains: np.ndarray):
        self.width = plane_bytes(len(gains))
        self.planes = []
        for sign in (1, -1):
            held = np.flatnonzero(gains * sign > 0)
            raw, first = to_planes(
                np.zeros(len(held), np.int64), held, np.abs(gains[held]), 1, self.width
            )
            words = np.frombuffer(raw, np.uint64).reshape(-1, self.width // 8)
            self.planes += [(sign, j, plane) for j, plane in enumerate(words)]

    def sums(self, raw: list[bytes]) -> np.ndarray:
        """Sum of count times gain for each document's planes: bits that both planes have,
        counted and shifted by the powers of two of both."""
        rows = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, self.width // 8)
        sizes = np.array([len(r) // self.width for r in raw], np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        power = np.arange(len(rows)) - np.repeat(ends[:-1], sizes)
        total = np.zeros(len(rows), np.int64)
        for sign, j, plane in self.planes:
            total += sign * (np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64) << j)
        summed = np.concatenate(([0], np.cumsum(total << power)))
        return summed[ends[1:]] - summed[ends[:-1]]


def _sliced(buckets: int, runs: tuple[int, int]):
    """Batches of (row key, _id, _text) -> planes of each; at the end the task's totals."""
    width = plane_bytes(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, totals = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            rows = list(enumerate(batch["_text"].to_pylist()))
            for block in pieces(rows, (max(len(t or ""), BLOCK // DOCS) for _, t in rows), BLOCK):
                words = [words_of(t) for _, t in block]
                own = [features_of(w, runs) for w in words]
                n = [len(f) for f in own]
                flat = np.fromiter(map(found.__getitem__, (f for o in own for f in o)), np.int64, sum(n))
                pairs, count = np.unique(
                    np.repeat(np.arange(len(own)), n) * buckets + flat, return_counts=True
                )
                owner, bucket = np.divmod(pairs, buckets)
                totals += np.bincount(bucket, count, buckets).astype(np.int64)
                raw, first = to_planes(owner, bucket, count, len(own), width)
                part = batch.slice(block[0][0], len(block))
                yield pa.RecordBatch.from_arrays(
                    [
                        part[ROW],
                        part["_id"],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(
                            [raw[a * width : b * width] for a, b in zip(first[:-1], first[1:], strict=True)],
                            pa.binary(),
                        ),
                        pa.nulls(len(block), pa.binary()),
                    ],
                    [ROW, "_id", "n_words", "n_features", "planes", "totals"],
                )
        if totals.any():
            columns = [pa.nulls(1, batch[ROW].type), pa.nulls(1, batch["_id"].type)]
            columns += [pa.nulls(1, pa.int64())] * 2 + [pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([totals.tobytes()], pa.binary())],
                [ROW, "_id", "n_words", "n_features", "planes", "totals"],
            )

    return run


def _planes(docs: DataFrame, buckets: int, runs: tuple[int, int], name: str) -> DataFrame:
    """keyed documents -> (row key, _id, n_words, n_features, planes), and rows with the
    totals that a task has counted; every text is read once, into the shared folder."""
    ddl = f"{ROW} long, _id {dict(docs.dtypes)['_id']}, n_words long, n_features long, planes binary, totals binary"
    return stage(docs.mapInArrow(_sliced(buckets, runs), ddl), name)


def _totals(sliced: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: one row a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch["totals"]:
                summed += np.frombuffer(raw.as_buffer(), np.int64)
        at = np.flatnonzero(summed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(summed[at])], ["bucket", "n"])

    own = sliced.filter("totals IS NOT NULL").select("totals").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in target and corpus."""
    buckets = len(corpus)
    all_target, all_corpus = float(target.sum() + buckets), float(corpus.sum() + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((float(t + 1) * all_corpus) / (float(s + 1) * all_target)))
            for t, s in zip(target.tolist(), corpus.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(id_col: str, seed: int) -> Column:
    """Thousandths of a Gumbel variable, from the id's digest; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _weighed(
    docs: DataFrame, target: DataFrame, buckets: int, runs: tuple[int, int], seed: int,
    min_words: int, percent: int,
) -> DataFrame:
    sliced = _planes(docs, buckets, runs, "planes")
    aims = _planes(target, buckets, runs, "target-planes")
    gains = Gains(gains_of(_totals(aims, buckets), _totals(sliced, buckets)))

    @F.arrow_udf("bigint")
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for planes in batches:
            raw = planes.to_pylist()
            parts = [gains.sums(raw[k : k + DOCS]) for k in range(0, len(raw), DOCS)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.int64())

    # A mean below zero is floored, not cut.
    mean = F.expr("coalesce((_sum - pmod(_sum, n_features)) div nullif(n_features, 0), 0)")
    scored = (
        sliced.filter(F.col("planes").isNotNull())
        .select(ROW, "_id", "n_words", "n_features", sums("planes").alias("_sum"))
        .withColumn("weight", mean)
        .withColumn("score", F.col("weight") + noise("_id", seed))
        .withColumn("_open", F.col("n_words") >= min_words)
        .drop("_sum")
    )
    order = [F.desc("_open"), F.desc("score"), F.asc_nulls_first("_id"), F.asc(ROW)]
    placed = with_positions(scored, order, "rank", write=lambda df: stage(df, "ranked"))
    drawn = placed.filter("_open").count() * percent // 100
    return placed.withColumn("rank", F.expr(f"CASE WHEN _open AND rank < {drawn} THEN rank + 1 END"))


def importance(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = 10_000,
    runs: tuple[int, int] = (1, 1),
    seed: int = 2024,
    min_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """One row per document: id_col, n_words, n_features, weight, score, rank.

    Features are runs of words, hashed to buckets. A document's counts become planes of
    bits, one plane for each power of two; so do the gains of the buckets (how much more
    frequent they are in `target` than in `docs`). The sum of counts times gains is the
    bits that two planes share, counted and shifted: whole numbers, exact. weight is the
    floored mean; score adds noise drawn from the id, so that the `percent` highest of the
    documents with `min_words` words are a sample without replacement in proportion to
    the weights. rank is the place among those drawn, null for all others.

    Texts are read once, into planes in the shared folder, with the totals of each task
    beside them; the driver sees one row a bucket and one count. Places come from ranges of
    the score. Null or empty text: no features, weight 0, never drawn if min_words > 0.
    Null ids: first in ties. Repeated rows or ids: documents of their own, which tie; ties go
    to the smaller id. Empty table: no rows. Very long texts: whole. Only the columns named
    are read, so others can't clash.
    """
    rows = keyed(docs, id_col, text_col)
    return _weighed(rows, _aims(target, target_col), buckets, runs, seed, min_words, percent).select(
        F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", "rank"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = 10_000,
    runs: tuple[int, int] = (1, 1),
    seed: int = 2024,
    min_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """The drawn documents with all their columns; cases as in `importance`."""
    rows, key = numbered(docs, id_col, text_col)
    own = rows.select(
        F.col(key).alias(ROW), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")
    )
    drawn = _weighed(own, _aims(target, target_col), buckets, runs, seed, min_words, percent)
    drawn = drawn.filter("rank IS NOT NULL").select(F.col(ROW).alias(key))
    return rows.join(drawn, key, "left_semi").drop(key)


def _aims(target: DataFrame, text_col: str) -> DataFrame:
    none = F.lit(None).cast("long")
    return target.select(none.alias(ROW), none.alias("_id"), F.col(text_col).cast("string").alias("_text"))

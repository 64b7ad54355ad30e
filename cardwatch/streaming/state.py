"""History features of a stream: one stored history per user.

State of a user: largest event time, and count and amount per 100 ms bucket within the
long window, as a map of cells of buckets. Per micro-batch and user the rows are
handled in arrival order with numpy, in blocks: each block asks the bucket table
and itself, then joins the table. Cells that changed are written, expired ones removed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cardwatch.config import Config
from cardwatch.operators.segments import arrivals
from cardwatch.operators.windows import STORE_FEATURES

#: Buckets of a state entry: each entry read or written is a call to the state store, so a
#: long window has about three.
CELL = 1024
#: Up to so many buckets are kept beside the largest time: one call each way for most users.
INLINE = 256
_ENTRY = "bucket array<long>, n array<long>, s array<double>"
#: Groups of users that the keyed operator is called for, so that a call serves many users.
SHARDS = 512
_BLOCK = 256

# Executors get the state function itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class History:
    """Bucket table of one user and its running maximum time."""

    def __init__(
        self, short: int, long: int, bucket_ms: int, tolerance_ms: int, state: tuple | None = None
    ):
        self.short, self.long = short, long
        self.bucket_ms, self.tolerance_ms = bucket_ms, tolerance_ms
        self.top, bucket, n, s = state if state else (None, (), (), ())
        self.bucket = np.asarray(bucket, dtype="int64")
        self.n = np.asarray(n, dtype="int64")
        self.s = np.asarray(s, dtype="float64")

    def as_tuple(self) -> tuple:
        return self.top, self.bucket.tolist(), self.n.tolist(), self.s.tolist()

    def ask_and_add(self, time: np.ndarray, amount: np.ndarray) -> np.ndarray:
        """Features of rows in arrival order, as of before each row."""
        blocks = [
            self._block(time[i : i + _BLOCK], amount[i : i + _BLOCK])
            for i in range(0, len(time), _BLOCK)
        ]
        return np.concatenate(blocks)

    def _block(self, time: np.ndarray, amount: np.ndarray) -> np.ndarray:
        least = np.iinfo("int64").min
        start = least if self.top is None else self.top
        tops = np.maximum.accumulate(np.concatenate(([start], time)))
        prev = tops[:-1]
        known = prev > 0
        late = known & (time < prev)
        held = ~(known & (prev - np.where(known, time, 0) > self.tolerance_ms))
        bucket = time // self.bucket_ms
        run = tops[1:] // self.bucket_ms

        oldest = run - (self.long - 1)
        oldest_short = np.maximum(bucket - (self.short - 1), oldest)
        earlier = np.tril(np.ones((len(time),) * 2, dtype=bool), -1) & held[None, :]
        out = np.empty((len(time), len(STORE_FEATURES)))
        for column, lo in ((0, oldest_short), (1, oldest)):
            mine = earlier & (bucket[None, :] >= lo[:, None]) & (bucket[None, :] <= bucket[:, None])
            first = np.searchsorted(self.bucket, lo)
            last = np.maximum(np.searchsorted(self.bucket, bucket, side="right"), first)
            out[:, column] = mine.sum(axis=1) + _range_sums(self.n, first, last)
            out[:, column + 2] = np.where(mine, amount[None, :], 0.0).sum(axis=1) + _range_sums(
                self.s, first, last
            )
        out[:, 4] = np.where(known & ~late, time - np.where(known, prev, time), 0)
        out[:, 5] = late

        self.top = int(tops[-1])
        self._add(bucket[held], amount[held], int(oldest[-1]))
        return out

    def _add(self, bucket: np.ndarray, amount: np.ndarray, oldest: int) -> None:
        """Adds weights to the table and drops the buckets before `oldest`."""
        every = np.concatenate((self.bucket, bucket))
        self.bucket, at = np.unique(every, return_inverse=True)
        n = np.concatenate((self.n, np.ones(len(bucket), dtype="int64")))
        self.n = np.bincount(at, n, len(self.bucket)).astype("int64")
        self.s = np.bincount(at, np.concatenate((self.s, amount)), len(self.bucket))
        keep = self.bucket >= oldest
        self.bucket, self.n, self.s = self.bucket[keep], self.n[keep], self.s[keep]


def _range_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of values[first:last] per pair; each slice is added up by itself."""
    padded = np.append(values, 0)
    ends = np.stack((first, last), axis=1).ravel()
    sums = np.add.reduceat(padded, ends)[::2] if len(ends) else np.zeros(0)
    return np.where(first < last, sums, 0)


class Keeper(StatefulProcessor):
    """The histories of a shard of users; a micro-batch writes the entries that it changed.

    A call for each user would cost more than the work on the user's rows, so Spark groups rows by
    shard. State stays one entry a user (largest time and up to `INLINE` buckets), and
    beyond that a map of cells. A shard's rows come by user and arrival and in pieces, one
    Arrow batch at a time, so memory holds one piece and one user's window of buckets,
    whatever the number of rows.
    """

    def __init__(
        self,
        columns: list[str],
        names: list[str],
        key: T.StructField,
        order: str,
        settings: tuple[int, int, int, int],
        idle_ms: int | None,
    ):
        self.columns, self.names, self.key, self.order = columns, names, key, order
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        cell = T.StructField("cell", T.LongType())
        head = f"top long, seen long, cells array<long>, {_ENTRY}"
        self.heads = handle.getMapState("heads", T.StructType([self.key]), head)
        self.cells = handle.getMapState("cells", T.StructType([self.key, cell]), _ENTRY)

    def handleInputRows(  # noqa: N802
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        now = None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        history, stored, last, met = None, {}, None, []
        closed = set()
        for piece in rows:
            # The planner names a column by what it is an alias of.
            piece.columns = self.columns
            arrival = piece[self.order].to_numpy()
            time = piece["_time"].to_numpy("int64")
            amount = piece["amount"].to_numpy("float64")
            codes, users = pd.factorize(piece[self.key.name])
            features = np.empty((len(piece), len(STORE_FEATURES)))
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for first, end in pairwise(edges):
                user = self._user(users, codes[first])
                if met != [user]:
                    if met:
                        self._store(met[0], history, stored, now)
                        closed.add(met[0])
                    (history, stored), last, met = self._load(user), None, [user]
                own = arrival[first:end]
                behind = last is not None and own[0] < last
                if user in closed or behind or (own[1:] < own[:-1]).any():
                    raise ValueError(f"rows of {user} do not come by {self.order}; start the query with start_sink")
                last = own[-1]
                features[first:end] = history.ask_and_add(time[first:end], amount[first:end])
            yield piece[self.names].assign(**{c: features[:, i] for i, c in enumerate(STORE_FEATURES)})
        if met:
            self._store(met[0], history, stored, now)
        if now is not None:
            self.handle.registerTimer(now + self.idle_ms)

    def _user(self, users: pd.Index, code: int) -> object:
        """The key as Spark knows it; pandas has no integers beside nulls."""
        if code < 0:
            return None
        user = users[code]
        user = user.item() if isinstance(user, np.generic) else user
        return int(user) if isinstance(self.key.dataType, T.IntegralType) else user

    def _load(self, user: object) -> tuple[History, dict[int, tuple]]:
        """The user's history, and its cells as stored."""
        top, _, numbers, *columns = self.heads.getValue((user,)) or (None, None, (), (), (), ())
        stored = {cell: self.cells.getValue((user, cell)) for cell in numbers}
        if stored:
            columns = [[v for cell in sorted(stored) for v in stored[cell][k]] for k in range(3)]
        return History(*self.settings, (top, *columns)), stored

    def _store(self, user: object, history: History, stored: dict[int, tuple], seen: int | None) -> None:
        top, *table = history.as_tuple()
        now = {}
        if len(history.bucket) > INLINE:
            cell = history.bucket // CELL
            edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)).tolist()
            for first, end in zip(edges, [*edges[1:], len(cell)], strict=True):
                now[int(cell[first])] = tuple(x[first:end] for x in table)
            table = [], [], []
        self.heads.updateValue((user,), (top, seen, list(now), *table))
        for number, entry in now.items():
            if number not in stored or tuple(map(list, stored[number])) != entry:
                self.cells.updateValue((user, number), entry)
        for number in stored.keys() - now.keys():
            self.cells.removeKey((user, number))

    def handleExpiredTimer(  # noqa: N802
        self, key: tuple, timerValues: object, expiredTimerInfo: object  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        """Forgets the shard's users who had no row since the timer was set."""
        end = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        idle = [(user, head[2]) for (user,), head in self.heads.iterator() if head[1] <= end]
        for user, numbers in idle:
            for number in numbers:
                self.cells.removeKey((user, number))
            self.heads.removeKey((user,))
        return iter(())

    def close(self) -> None:
        pass


def store_features_stream(
    tx: DataFrame,
    cfg: Config = Config(),
    key: str = "user_id",
    order: str = "arrival_seq",
    idle_timeout_ms: int | None = None,
) -> DataFrame:
    """`store_features` for a streaming DataFrame.

    No watermark: late rows are scored however late, and lateness is per user.
    State of a user stays for ever unless `idle_timeout_ms` is given, which
    changes the features of users who come back later than that.

    Users are grouped in shards by a hash, their rows sorted by Spark by shard, user and
    arrival, on disk where they are many. `SHARDS` is part of the stored state: a
    checkpoint needs the number that it was begun with. Spark's check
    of streaming plans refuses every sort, also this one within a micro-batch, and map state
    needs RocksDB: start the query with `start_sink`, or under `stateful_settings`. Rows out
    of order stop the query.
    """
    events = arrivals(tx, cfg).drop("_segment", "_low", "_bucket", "_n", "_sum", "_real")
    settings = cfg.short_buckets, cfg.long_buckets, cfg.bucket_ms, cfg.late_tolerance_ms
    out = T.StructType(
        [*tx.schema.fields, *[T.StructField(c, T.DoubleType()) for c in STORE_FEATURES]]
    )
    shard = "_shard"
    events = events.withColumn(shard, F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int"))
    keeper = Keeper(events.columns, tx.columns, tx.schema[key], order, settings, idle_timeout_ms)
    mode = "none" if idle_timeout_ms is None else "processingTime"
    ordered = events.repartition(shard).sortWithinPartitions(shard, key, order)
    return ordered.groupBy(shard).transformWithStateInPandas(keeper, out, "append", mode)


@contextmanager
def stateful_settings(spark: SparkSession) -> Iterator[None]:
    """Session settings under which a stream with keyed history has to be started."""
    needed = {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.streaming.unsupportedOperationCheck": "false",
    }
    before = {name: spark.conf.get(name, None) for name in needed}
    for name, value in needed.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored_buckets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped stream has in its state: a row for each user and bucket, with count and
    amount of the accepted rows."""
    read = spark.read.format("statestore")
    inline, cells = (
        read.option("stateVarName", name).load(checkpoint).select("user_map_key.*", "user_map_value.*")
        for name in ("heads", "cells")
    )
    every = inline.drop("top", "seen", "cells").unionByName(cells.drop("cell"))
    entry = F.arrays_zip("bucket", "n", "s")
    return every.select(*every.columns[:-3], F.inline(entry).alias("bucket", "cnt", "amount_sum"))

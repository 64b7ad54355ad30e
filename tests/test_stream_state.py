import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from cardwatch.streaming import state as keyed
from cardwatch.streaming.state import STORE_FEATURES, History
from tests.model import history_features


@pytest.mark.parametrize("start", [1_700_000_000_000, -400_000])
@pytest.mark.parametrize("short, long", [(600, 3000), (10, 20), (300, 100)])
def test_blocks_match_model(start, short, long):
    rnd = random.Random(short)
    clock, rows = start, []
    for i in range(1_200):
        clock += rnd.choice([0, 10, 90, 400, 1_500, 30_000])
        late = rnd.choice([0, 0, 0, 100, 1_900, 2_000, 2_001, 50_000, 400_000])
        rows.append(("u", i, clock - late, float(rnd.randrange(1, 9_999)) / 100))
    want = history_features(rows, short, long)

    settings = short, long, 100, 2_000
    state, got, i = None, [], 0
    while i < len(rows):
        n = rnd.choice([1, 2, 50, 700])
        part = rows[i : i + n]
        history = History(*settings, state)
        got.append(
            history.ask_and_add(
                np.array([r[2] for r in part]), np.array([r[3] for r in part])
            )
        )
        state = history.as_tuple()
        i += n
    got = np.concatenate(got)
    assert got.shape == (len(rows), len(STORE_FEATURES))
    for r, values in zip(rows, got):
        assert values == pytest.approx(want["u", r[1]], abs=1e-6)


class Map(dict):
    """A map state as the operator sees it."""

    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]

    def iterator(self):
        return iter(self.items())


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, key, value):  # noqa: N802
        return self.maps.setdefault(name, Map())

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_one_call_serves_a_shard_and_forgets_idle_users_only(monkeypatch):
    monkeypatch.setattr(keyed, "INLINE", 2)
    columns = ["user_id", "arrival_seq", "_time", "amount"]
    key = T.StructField("user_id", T.StringType())
    keeper, handle = keyed.Keeper(columns, columns[:2], key, "arrival_seq", (50, 200, 100, 2_000), 1_000), Handle()
    keeper.init(handle)
    rows = [(f"u{u}", 10 * u + i, 1_000_000 + 700 * i, 1.0) for u in range(30) for i in range(7)]
    want = history_features(rows, 50, 200)
    # The first of both micro-batches has all users, the second the first ten of them.
    got = {}
    for now, part in ((5_000, [r for r in rows if r[1] % 10 < 4]), (5_600, [r for r in rows if r[1] % 10 > 3 and r[1] < 100])):
        clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda now=now: now)
        pieces = [pd.DataFrame(part[k : k + 5], columns=columns) for k in range(0, len(part), 5)]
        for out in keeper.handleInputRows((0,), iter(pieces), clock):
            for r in out.itertuples(index=False):
                got[r.user_id, r.arrival_seq] = tuple(r[2:])
    assert got == {k: tuple(map(float, v)) for k, v in want.items() if k in got}
    assert len(got) == 30 * 4 + 10 * 3 and handle.timers == [6_000, 6_600]
    keeper.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 6_000))
    kept = {f"u{u}" for u in range(10)}
    assert {user for (user,) in handle.maps["heads"]} == kept == {user for user, _ in handle.maps["cells"]}
    late = pd.DataFrame([("u1", 18, 1, 1.0), ("u2", 28, 1, 1.0), ("u1", 19, 1, 1.0)], columns=columns)
    with pytest.raises(ValueError, match="start_sink"):
        list(keeper.handleInputRows((0,), iter([late]), clock))

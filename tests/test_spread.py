"""Shuffles get as many tasks as the counted rows ask for, and the same results."""

import random
from dataclasses import replace

import pytest

from cardwatch.config import Config
from cardwatch.models import default_models, weights_table
from cardwatch.operators import spread
from cardwatch.operators.linear_long import linear_score_long
from cardwatch.operators.segments import segmented
from cardwatch.operators.windows import STORE_FEATURES, store_features
from tests.model import history_features

TX = "user_id string, arrival_seq long, event_time_ms long, amount double"


def exchanges(df, tasks):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and f", {tasks}), REPARTITION_BY_NUM" in line for line in plan.split("\n"))


@pytest.mark.parametrize("heavy_rows", [10**6, 0])
def test_windows(spark, monkeypatch, heavy_rows):
    monkeypatch.setattr(spread, "TASK_ROWS", 20)
    rnd, clock, rows = random.Random(3), 1_700_000_000_000, []
    for seq in range(400):
        clock += rnd.choice([0, 50, 400, 3_000])
        rows.append((f"u{rnd.randrange(9)}", seq, clock - rnd.choice([0, 0, 1_900, 2_500]), float(rnd.randrange(99))))
    cfg = replace(Config(), heavy_rows=heavy_rows, segment_rows=16)
    tx = spark.createDataFrame(rows, TX)
    found, users = segmented(tx, cfg)
    assert users.rows == 400 and exchanges(found, 20)
    want = history_features(rows)
    for r in store_features(tx, cfg).collect():
        assert tuple(r[c] for c in STORE_FEATURES) == pytest.approx(want[r.user_id, r.arrival_seq], abs=1e-6)
    assert segmented(tx.limit(0), cfg)[1].rows == 0


def test_linear_scores(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 10)
    names = ("amount_log", "mcc_risk", "is_3ds", "none")
    rows = [(i, n, k / 3 + i % 5) for i in range(300) for k, n in enumerate(names)]
    long = spark.createDataFrame(rows, "id long, name string, value double")
    weights = weights_table(spark, default_models())
    many = linear_score_long(long, weights, ["id"], 300)
    assert exchanges(many, 30) == 1
    few = {(r.id, r.model): r.score for r in linear_score_long(long, weights, ["id"]).collect()}
    assert {(r.id, r.model): r.score for r in many.collect()} == pytest.approx(few) and len(few) == 600

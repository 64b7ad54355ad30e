from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardwatch.config import Config
from cardwatch.functions import features as X
from cardwatch.functions import scoring as S
from cardwatch.models import ArrowModel, BIAS, LinearModel, default_models, weights_table
from cardwatch.operators.features import feature_long
from cardwatch.operators.linear_long import linear_score_long
from cardwatch.operators.lookup import mcc_risk_lookup
from cardwatch.plans.score import score_transactions, with_scores
from cardwatch.schemas import FEATURES

CFG = Config()
MODELS = default_models()


def features(spark, *rows):
    """Rows of (amount, foreign, mcc_risk, 3ds, extra features)."""
    data = []
    for i, (amount, foreign, mcc, secure, extra) in enumerate(rows):
        base = dict.fromkeys(FEATURES, 0.0)
        base |= {"is_foreign": foreign, "mcc_risk": mcc, "is_3ds": secure, **extra}
        data.append((i, float(amount), *[float(base[f]) for f in FEATURES]))
    df = spark.createDataFrame(
        data, "id int, amount double, " + ", ".join(f"{f} double" for f in FEATURES)
    )
    return df.withColumn("amount_log", X.amount_log(F.col("amount")))


HISTORY = {"velocity_300s": 5, "amount_sum_300s": 300, "inter_arrival_ms": 100}
RISKY = {"device_risky": 1, "ip_risky": 1}
KNOWN = [
    ((128.5, 0, 0.2, 1, {}), 0.868155, 0.782305, "none", "deny"),
    ((10, 0, 0.2, 1, {}), 0.460599, 0.375618, "l2", "allow"),
    ((10, 0, 0.2, 0, {}), 0.460599, 0.572439, "l2", "allow"),
    ((20, 0, 1.0, 0, {}), 0.597867, 0.817128, "l2", "manual_review"),
    ((20, 0, 1.0, 0, HISTORY), 0.597867, 0.921797, "l2", "deny"),
    ((1, 0, 0.2, 1, {}), 0.119203, 0.107168, "none", "allow"),
    ((-5, 1, 0.2, 0, RISKY), 0.029767, 0.028096, "none", "allow"),
]


def test_known_scores(spark):
    df = features(spark, *[k[0] for k in KNOWN])
    df = with_scores(df, MODELS, CFG).withColumn("l2", S.linear_score(MODELS.l2, df.columns))
    for row, (_, s1, s2, route, decision) in zip(df.orderBy("id").collect(), KNOWN):
        assert row.s1 == pytest.approx(s1, abs=1e-6)
        assert row.l2 == pytest.approx(s2, abs=1e-6)
        assert (row.route, row.decision) == (route, decision)
        assert row.score == (row.l2 if route == "l2" else row.s1)
        signals = [item.signal for item in row.reason]
        assert signals[:4] == ["amount_log", "velocity_60s", "is_foreign", "mcc_risk"]
        assert signals[4:] == (["layer2_used"] if route == "l2" else [])


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_band_and_thresholds(spark):
    assert column(spark, [0.35, 0.350001, 0.649999, 0.65], lambda v: S.in_band(v, CFG)) == [
        False, True, True, False,
    ]
    got = column(spark, [0.649999, 0.65, 0.849999, 0.85], lambda v: S.decide(v, None, CFG))
    assert got == ["allow", "manual_review", "manual_review", "deny"]


def test_nan_reaches_no_threshold(spark):
    nan = float("nan")
    assert column(spark, [nan, 0.9], lambda v: S.decide(v, None, CFG)) == ["allow", "deny"]
    df = features(spark, (1, 0, 0.2, 1, {"velocity_60s": nan}))
    items = df.select(S.reasons(F.lit(False)).alias("r")).first().r
    assert {i.signal: i.direction for i in items}["velocity_60s"] == "risk_down"


def test_first_of_equal_names_counts(spark):
    rows = [(1, "x", 2.0, 1), (1, "x", 1.0, 0)]
    frame = spark.createDataFrame(rows, "id int, name string, value double, position int")
    weights = spark.createDataFrame(
        [("m", "x", 1.0), ("m", "bias", 0.0)], "model string, feature string, weight double"
    ).replace("bias", BIAS)
    by_place = linear_score_long(frame, weights, ["id"]).first().score
    by_value = linear_score_long(frame.drop("position"), weights, ["id"]).first().score
    assert by_place == by_value == pytest.approx(0.731059, abs=1e-6)


def test_budget(spark):
    got = column(
        spark, [None, 8_999, 9_000, 9_999, 10_000, 10_001],
        lambda v: S.route(F.lit(0.5), v, CFG), "long",
    )
    assert got == ["l2", "l2"] + ["skipped_budget"] * 2 + ["timeout_before_l2"] * 2
    got = column(spark, [None, 10_000, 10_001], lambda v: S.decide(F.lit(0.9), v, CFG), "long")
    assert got == ["deny", "deny", "degrade_allow"]


def test_row_features(spark):
    got = column(spark, [float("nan"), 0.0, -3.0, 1.0], X.amount_log)
    assert got == pytest.approx([-4.605170, -4.605170, -4.605170, 0.0], abs=1e-6)
    assert column(spark, ["JP", "US", "jp"], X.is_foreign, "string") == [0, 1, 1]
    assert column(spark, [7995, 6011, 4829, 1], X.mcc_risk, "int") == [1.0, 0.8, 0.6, 0.2]
    assert column(spark, ["d_10", "d_1", ""], X.device_risky, "string") == [1, 0, 0]
    assert column(spark, ["198.1", "198", "1198."], X.ip_risky, "string") == [1, 0, 0]
    assert column(spark, [-450, -1, 0, 99, 100], lambda v: X.bucket(v, CFG), "long") == [
        -5, -1, 0, 0, 1,
    ]
    assert column(spark, [-1000.0, 0.0, 1000.0], S.sigmoid) == [0.0, 0.5, 1.0]
    assert column(spark, [-0.1, 0.5, 1.1], S.clamp01) == [0.0, 0.5, 1.0]


def test_models_as_data(spark):
    extra = LinearModel("l2", 0.25, (("no_such_feature", 9.0),))
    models = replace(MODELS, l2=extra)
    wide = features(spark, *[k[0] for k in KNOWN])
    long = feature_long(wide, "id")
    got = linear_score_long(long, weights_table(spark, models), ["id"]).collect()
    scores = {(r.id, r.model): r.score for r in got}
    for i, k in enumerate(KNOWN):
        assert scores[i, "l1"] == pytest.approx(k[1], abs=1e-6)
    # No term of this model matches, so no row of it comes from a join on terms alone.
    assert scores[0, "l2"] == pytest.approx(0.562177, abs=1e-6)


def test_scored_record_ids(spark):
    tx = spark.createDataFrame(
        [("u", i, 10**12 + i, 5.0, 5411, "JP", "d_1", "1.1", True, "a" * 8 if i else None) for i in range(3)],
        "user_id string, arrival_seq long, event_time_ms long, amount double, mcc int, "
        "country string, device_id string, ip_prefix string, is_3ds boolean, trace_id string",
    )
    ids = [r.trace_id for r in score_transactions(tx).orderBy("arrival_seq").collect()]
    assert ids[1:] == ["a" * 8] * 2 and len(ids[0]) == 36


def test_arrow_model_sees_its_route_only(spark):
    seen, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    model = MODELS.l2

    def load():
        loads.add(1)

        def score(rows):
            seen.add(len(rows))
            z = model.bias + sum(w * rows[f].to_numpy() for f, w in model.weights)
            return pa.array(1 / (1 + np.exp(-z)))

        return score

    rows = features(spark, *[k[0] for k in KNOWN] * 30).coalesce(2)
    want = with_scores(rows, MODELS, CFG).orderBy("id").collect()
    scored = with_scores(rows, replace(MODELS, l2=ArrowModel("own", load)), CFG)
    # A filter on the score must not make the model run once more.
    got = scored.filter("score >= 0").orderBy("id").collect()
    assert [r.s2 for r in got] == pytest.approx([r.s2 for r in want])
    assert [(r.route, r.decision) for r in got] == [(r.route, r.decision) for r in want]
    # The sort reads its input twice, to find ranges.
    on_route = sum(r.route == "l2" for r in want)
    assert on_route < len(want) and seen.value in (on_route, 2 * on_route)
    assert loads.value <= 4


def test_arrow_model_null_and_length(spark):
    rows = features(spark, *[k[0] for k in KNOWN])
    nulls = ArrowModel("nulls", lambda: lambda rows: pa.nulls(len(rows), pa.float64()))
    got = with_scores(rows, replace(MODELS, l2=nulls), CFG).filter("route = 'l2'").collect()
    assert got and all(np.isnan(r.score) and r.decision == "allow" for r in got)
    short = ArrowModel("short", lambda: lambda rows: pa.array([0.5]))
    with pytest.raises(Exception, match="short: 1 scores for 4 rows"):
        with_scores(rows.coalesce(1), replace(MODELS, l2=short), CFG).collect()


@pytest.mark.parametrize("broadcast_codes", [100, 1])
def test_mcc_risk_lookup(spark, broadcast_codes):
    tx = spark.createDataFrame(
        [(i, m, 9.0) for i, m in enumerate([1, 1, 2, 3, None] + [4] * 200)], "id int, mcc int, mcc_risk double"
    )
    risks = spark.createDataFrame(
        [(1, 0.5), (1, 0.7), (2, None), (None, 0.9), (4, 0.0)], "mcc int, risk double"
    )
    rated = mcc_risk_lookup(tx, risks, broadcast_codes=broadcast_codes)
    assert rated.columns == ["id", "mcc", "mcc_risk"]
    got = [r.mcc_risk for r in rated.orderBy("id").collect()]
    assert got == [0.7, 0.7, 0.2, 0.2, 0.2] + [0.0] * 200
    plan = rated._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (broadcast_codes == 100)
    assert mcc_risk_lookup(tx, risks.limit(0), broadcast_codes=broadcast_codes).filter("mcc_risk = 0.2").count() == 205

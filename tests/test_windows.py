import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cardwatch.config import Config
from cardwatch.operators.expiry import expired
from cardwatch.operators.segments import segmented
from cardwatch.operators.windows import STORE_FEATURES, store_features, with_lateness
from tests.model import history_features

TX = "user_id string, arrival_seq long, event_time_ms long, amount double"


def run(spark, rows, cfg=Config()):
    df = store_features(spark.createDataFrame(rows, TX), cfg)
    return {
        (r.user_id, r.arrival_seq): tuple(r[c] for c in STORE_FEATURES) for r in df.collect()
    }


def case(spark, *arrivals, base=0):
    rows = [("u", i, base + t, float(a)) for i, (t, a) in enumerate(arrivals, 1)]
    got = run(spark, rows)
    return [dict(zip(STORE_FEATURES, got["u", i])) for i in range(1, len(rows) + 1)]


# The same cases shortly after 1970 and at a present-day time.
@pytest.fixture(params=[0, 1_700_000_000_000])
def base(request):
    return request.param


def test_point_in_time(spark, base):
    one, two = case(spark, (1000, 10), (1050, 5), base=base)
    assert one["velocity_60s"] == 0 and one["amount_sum_300s"] == 0
    assert two["velocity_60s"] == 1 and two["amount_sum_300s"] == 10


def test_short_window_ends_before_long(spark, base):
    _, two = case(spark, (0, 7), (60100, 1), base=base)
    assert (two["velocity_60s"], two["velocity_300s"], two["amount_sum_300s"]) == (0, 1, 7)


def test_severely_late_is_scored_not_stored(spark, base):
    _, two, three = case(spark, (10000, 10), (7000, 5), (10100, 1), base=base)
    assert two["oo_order_flag"] == 1
    assert three["amount_sum_300s"] == 10


def test_tolerance_boundary(spark, base):
    _, two, three = case(spark, (10000, 10), (8000, 5), (10100, 1), base=base)
    assert (two["oo_order_flag"], two["velocity_60s"], two["inter_arrival_ms"]) == (1, 0, 0)
    assert (three["velocity_60s"], three["amount_sum_300s"]) == (2, 15)
    assert three["inter_arrival_ms"] == 100
    *_, three = case(spark, (10000, 10), (7999, 5), (10100, 1), base=base)
    assert (three["velocity_60s"], three["amount_sum_300s"]) == (1, 10)


def test_bucket_distance(spark, base):
    _, two, three = case(spark, (100000, 1), (159900, 1), (160000, 1), base=base)
    assert two["velocity_60s"] == 1
    assert (three["velocity_60s"], three["velocity_300s"]) == (1, 2)
    _, two, three = case(spark, (100000, 1), (399900, 1), (400000, 1), base=base)
    assert two["velocity_300s"] == 1
    assert three["velocity_300s"] == 1


def test_late_row_does_not_see_later_buckets(spark, base):
    *_, three = case(spark, (100000, 1), (101000, 2), (100500, 4), base=base)
    assert (three["velocity_60s"], three["amount_sum_300s"], three["oo_order_flag"]) == (1, 1, 1)


def test_same_bucket(spark, base):
    _, two = case(spark, (50000, 1), (50000, 2), base=base)
    assert (two["velocity_60s"], two["amount_sum_300s"]) == (1, 1)
    assert (two["oo_order_flag"], two["inter_arrival_ms"]) == (0, 0)


def test_future_clamp(spark):
    df = spark.createDataFrame(
        [("u", 1, 90_000 + 10**12, 1.0, 10**12), ("u", 2, 90_000 + 10**12, 1.0, None)],
        TX + ", ingest_time_ms long",
    )
    rows = with_lateness(df).orderBy("arrival_seq").collect()
    assert [r.time_ms for r in rows] == [10**12 + 60_000, 10**12 + 90_000]


def trace(seed, n, users, start):
    rnd = random.Random(seed)
    clock = {u: start for u in range(users)}
    rows = []
    for i in range(n):
        # One user has a third of all rows.
        u = 0 if rnd.random() < 0.34 else rnd.randrange(users)
        clock[u] += rnd.choice([0, 0, 10, 90, 100, 400, 1_500, 5_000, 40_000])
        t = clock[u]
        if rnd.random() < 0.4:
            t -= rnd.choice([50, 100, 300, 1_900, 2_000, 2_001, 2_100, 6_000, 70_000, 310_000])
        if rnd.random() < 0.01:
            t += 60_000
        rows.append((f"u{u}", i * 3, t, float(rnd.randrange(1, 10_000)) / 100))
    return rows


SETTINGS = {
    "plain": {},
    "all users heavy": {"heavy_rows": 0, "segment_rows": 40},
    "some users heavy": {"heavy_rows": 120, "segment_rows": 100},
    "heavy users by shuffle": {"heavy_rows": 50, "segment_rows": 64, "heavy_listed": 1},
    "all users dense": {"dense_rows": 0},
    "some users dense": {"dense_rows": 3},
    "dense and heavy": {"dense_rows": 0, "heavy_rows": 120, "segment_rows": 100},
    "dense short windows": {"dense_rows": 0, "short_window_s": 1, "long_window_s": 2, "late_tolerance_ms": 300},
    "dense at the limit": {"dense_rows": 0, "short_window_s": 4, "long_window_s": 9},
    "tiny segments": {"heavy_rows": 10, "segment_rows": 1},
    "short windows": {"short_window_s": 1, "long_window_s": 2},
    "windows at the limit": {"short_window_s": 4, "long_window_s": 9},
    "short longer than long": {"short_window_s": 30, "long_window_s": 10},
    "coarse tolerance": {"late_tolerance_ms": 1_950},
}


PRESENT, BEFORE_1970 = 1_700_000_000_000, -500_000


@pytest.mark.parametrize(
    "name, start",
    [(name, PRESENT) for name in SETTINGS]
    + [("plain", BEFORE_1970), ("all users heavy", BEFORE_1970)],
)
def test_random_traces(spark, name, start):
    cfg = replace(Config(), **SETTINGS[name])
    rows = trace(list(SETTINGS).index(name), 900, 5, start)
    want = history_features(
        rows, cfg.short_buckets, cfg.long_buckets, cfg.bucket_ms, cfg.late_tolerance_ms
    )
    got = run(spark, rows, cfg)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6), k


def test_one_bucket_holds_a_third(spark):
    rows = [("u", i, 1_700_000_000_000 + (0 if i % 3 else 40 * i), 1.0) for i in range(1, 1500)]
    want = history_features(rows)
    cfg = Config(heavy_rows=100, segment_rows=50)
    assert run(spark, rows, cfg) == want
    assert run(spark, rows) == want


def test_one_shuffle_for_light_users(spark):
    tx = spark.range(1000).select(
        F.concat(F.lit("u"), F.col("id") % 7).alias("user_id"),
        F.col("id").alias("arrival_seq"),
        (F.col("id") * 700 + 10**12).alias("event_time_ms"),
        F.lit(1.0).alias("amount"),
    )
    plan = store_features(tx)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    # The same exchange feeds both branches; it is reused at run time.
    assert initial.count("Exchange hashpartitioning") == 2
    assert "Join" not in initial and "CartesianProduct" not in initial


def test_dense_rows_of_every_bucket(spark):
    rnd = random.Random(2)
    rows = [("u", i, 1_700_000_000_000 + 100 * i - rnd.choice([0] * 9 + [1_500]), 1.0) for i in range(7_000)]
    got = run(spark, rows, Config(long_window_s=120))
    want = run(spark, rows, Config(long_window_s=120, dense_rows=10**9))
    assert got == want
    assert max(v[0] for v in got.values()) > 590


def test_segments_of_sparse_arrival_numbers(spark):
    rows = [(u, i * i * 10**9, 1_700_000_000_000 + 900 * i, 1.0) for u in ("u", "v") for i in range(500)]
    cfg = Config(heavy_rows=100, segment_rows=40)
    cut, users = segmented(spark.createDataFrame(rows, TX), cfg)
    sizes = cut.filter("_real").groupBy("user_id", "_segment").count().collect()
    assert users.heavy.count() == 2
    assert sorted(r["count"] for r in sizes) == [20] * 2 + [40] * 24
    plain = {(u, i): v for (u, i), v in run(spark, rows).items()}
    assert run(spark, rows, cfg) == plain


@pytest.mark.parametrize("settings", [{}, {"heavy_rows": 50, "segment_rows": 30}])
def test_expiry_against_brute_force(spark, settings):
    cfg = replace(Config(), short_window_s=2, long_window_s=4, late_tolerance_ms=3_000, **settings)
    rnd, clock, rows = random.Random(6), 1_700_000_000_000, []
    for i in range(900):
        clock += rnd.choice([0, 40, 100, 300])
        late = rnd.choice([0, 0, 0, 500, 1_000, 2_900, 3_001, 9_000])
        rows.append((f"u{i % 3}", i * 7, clock - late, float(rnd.randrange(1, 999))))
    seen, want = {}, {}
    for user, seq, t, amount in rows:
        past = seen.setdefault(user, [])
        b, top = t // 100, max((p[0] for p in past), default=None)
        newest = b if top is None else max(b, top // 100)
        lost = [p[1] for p in past if p[2] and b - 40 < p[0] // 100 <= b and p[0] // 100 <= newest - 40]
        want[user, seq] = (newest - 39, len(lost), sum(lost))
        past.append((t, amount, top is None or top - t <= 3_000))
    got = expired(spark.createDataFrame(rows, TX).repartition(3), cfg).collect()
    assert {(r.user_id, r.arrival_seq): (r.oldest_bucket, r.dropped_n, r.dropped_amount) for r in got} == want
    assert sum(v[1] > 0 for v in want.values()) > 100

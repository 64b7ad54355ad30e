import random

from cardwatch.operators import knee, load_stats
from cardwatch.sources import tables
from tests.conftest import SF01


def summary(spark, rows):
    return spark.createDataFrame(
        rows, "runtime string, rps long, ok long, dropped long, p99_us long"
    )


def test_nearest_rank(spark):
    values = [("a", v) for v in range(10)] + [("b", 7)]
    got = load_stats.nearest_rank(
        spark.createDataFrame(values, "g string, v long"), ["g"], "v", (50, 95, 99)
    )
    rows = {r.g: (r.n, r.p50, r.p95, r.p99) for r in got.collect()}
    assert rows == {"a": (10, 5, 9, 9), "b": (1, 7, 7, 7)}


def test_nearest_rank_over_bins(spark):
    rnd = random.Random(3)
    # A third of all rows share one value; the rest spread over many bins.
    values = [70_000 if rnd.random() < 0.33 else int(rnd.expovariate(1e-6)) for _ in range(5_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = load_stats.nearest_rank(df, [], "v", (1, 50, 90, 99)).first()
    values.sort()
    for p in (1, 50, 90, 99):
        assert row[f"p{p}"] == values[int(p / 100 * (len(values) - 1) + 0.5)]


def test_lag(spark):
    lags = [1000, 1001, 2500, 0]
    ticks = spark.createDataFrame(
        [("a", 1_000_000, i, lag) for i, lag in enumerate(lags)],
        "runtime string, rps long, seq long, lag_ns long",
    )
    assert load_stats.missed_ticks(ticks).first().missed_ticks_total == 3
    row = load_stats.bench_lag(ticks).first()
    assert (row.bench_lag_p99_us, row.bench_lag_max_us) == (2, 2)


def test_planted_knee(spark):
    events = tables.read_table(spark, SF01, "events")
    got = load_stats.bench_summary(tables.samples(events))
    p99 = {}
    for r in got.orderBy("rps").collect():
        p99.setdefault(r.runtime, []).append(r.p99_us)
    assert p99 == {
        "a": [22313, 21861, 0, 22487, 21718, 44066, 39640, 49532],
        "b": [26876, 20994, 24197, 18235, 19785, 44536, 48726],
    }
    rows = knee.find_knee(got).collect()
    assert {r.knee_rps for r in rows} == {6000}
    assert max(r.rps for r in rows) == 6000 and len(rows) == 12


def test_levels_without_samples_are_rows(spark):
    samples = spark.createDataFrame(
        [("a", 1000, True, 5), ("a", 3000, False, 7), (None, 1000, True, 9)],
        "runtime string, rps long, ok boolean, us long",
    ).selectExpr("runtime", "rps", "ok", *[f"us AS {m}_us" for m in load_stats.MEASURES])
    levels = spark.createDataFrame(
        [("a", 1000, 0), ("a", 2000, 50), (None, 1000, 0)], "runtime string, rps long, dropped long"
    )
    ticks = spark.createDataFrame([("a", 4000, 1, 2_500)], "runtime string, rps long, seq long, lag_ns long")
    got = load_stats.bench_summary(samples, ticks, levels)
    rows = {
        (r.runtime, r.rps): (r.ok, r.err, r.dropped, r.p99_us, r.bench_lag_max_us) for r in got.collect()
    }
    assert rows == {
        ("a", 1000): (1, 0, 0, 5, 0),
        ("a", 2000): (0, 0, 50, 0, 0),
        ("a", 3000): (0, 1, 0, 0, 0),
        ("a", 4000): (0, 0, 0, 0, 2),
        (None, 1000): (1, 0, 0, 9, 0),
    }
    assert {r.knee_rps for r in knee.find_knee(got).collect()} == {2000}


def test_summary_without_ok_samples(spark):
    samples = spark.createDataFrame(
        [("a", 1000, False, 5, 5, 5, 5, 5, 5)],
        "runtime string, rps long, ok boolean, e2e_us long, feature_us long, router_us long, "
        "l1_us long, l2_us long, serialize_us long",
    )
    row = load_stats.bench_summary(samples).first()
    assert (row.ok, row.err, row.dropped, row.p99_us, row.l2_p99_us) == (0, 1, 0, 0, 0)


def test_knee_rules(spark):
    def reasons(*levels):
        rows = [("a", 1000 * (i + 1), ok, dropped, p99) for i, (ok, dropped, p99) in enumerate(levels)]
        got = knee.knee_reasons(summary(spark, rows)).orderBy("rps").collect()
        return [r.reason is not None for r in got]

    # Equal to the relative threshold is no knee; one more is.
    assert reasons((9, 0, 1000), (9, 0, 1300)) == [False, False]
    assert reasons((9, 0, 1000), (9, 0, 1301)) == [False, True]
    # A big relative rise below the absolute one is none.
    assert reasons((9, 0, 100), (9, 0, 300)) == [False, False]
    # Levels with drops or without samples are no yardstick.
    assert reasons((9, 0, 1000), (9, 3, 9000), (0, 0, 0), (9, 0, 1200)) == [
        False, True, False, False,
    ]


def test_find_knee_keeps_all_runtimes_of_the_level(spark):
    rows = [("a", 1000, 9, 0, 10), ("b", 1000, 9, 0, 10), ("a", 2000, 9, 1, 10), ("b", 2000, 9, 0, 10)]
    rows += [("a", 3000, 9, 0, 10), ("b", 3000, 9, 0, 10)]
    got = knee.find_knee(summary(spark, rows)).collect()
    assert sorted((r.runtime, r.rps) for r in got) == [
        ("a", 1000), ("a", 2000), ("b", 1000), ("b", 2000),
    ]
    assert knee.find_knee(summary(spark, rows[:2])).count() == 2

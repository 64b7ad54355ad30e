import json
from collections import Counter

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from cardwatch.sources.counters import COUNTERS, scrape_counters
from cardwatch.sources.levels import list_levels, rps_levels
from cardwatch.sources.requests import dead_letter_split, decode_requests
from cardwatch.sources.responses import decode_responses
from cardwatch.sources.synth import synth_transactions

SAMPLE = {
    "trace_id": None,
    "event_time_ms": 1_712_000_555_007,
    "user_id": "u_905",
    "card_id": "c_311",
    "merchant_id": "m_64",
    "mcc": 4812,
    "amount": 73.25,
    "currency": "EUR",
    "country": "FR",
    "channel": "atm",
    "device_id": "d_88",
    "ip_prefix": "192.0.2",
    "is_3ds": False,
}


def line(**changes):
    return json.dumps({**SAMPLE, **changes})


def without(name):
    return json.dumps({k: v for k, v in SAMPLE.items() if k != name})


CONTRACT = [
    (line(), None),
    (line(channel="ECOM"), "channel"),
    (without("trace_id"), None),
    (line(trace_id="3f2b8c1e-9a47-4d16-8e55-0b7c6d2a1f90"), None),
    (line(trace_id="3f2b8c1e"), "trace_id"),
    (without("amount"), "missing: amount"),
    (line(amount=None), "missing: amount"),
    (line(amount=5), None),
    (line(amount="x"), "type: amount"),
    (line(amount="5"), "type: amount"),
    (line(mcc=99999999999), "range: mcc"),
    (line(mcc=5411.5), "type: mcc"),
    (line(event_time_ms=10**19), "range: event_time_ms"),
    (line(user_id=42), "type: user_id"),
    (line(is_3ds="true"), "type: is_3ds"),
    (line(extra={"user_id": 1}), None),
    (line(extra={"amount": 5})[:-1] + ', "z": "user_id: STRING>"}', None),
    (without("amount")[:-1] + ', "extra": {"amount": 5}}', "missing: amount"),
    (line()[:-1] + ', "mcc": 1}', "syntax"),
    (line(amount=10**25), None),
    ("[1]", "missing: event_time_ms"),
    ("null", "missing: event_time_ms"),
    ("{bad", "syntax"),
    ("", "syntax"),
]


def test_request_contract(spark):
    raw = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CONTRACT)], "i int, value string")
    decoded = decode_requests(raw)
    got = {r.i: r.cause for r in decoded.collect()}
    assert got == {i: cause for i, (_, cause) in enumerate(CONTRACT)}
    valid, dead = dead_letter_split(decoded)
    assert valid.count() + dead.count() == len(CONTRACT)
    first = valid.filter("i = 0").drop("i", "value").first().asDict()
    assert first == SAMPLE


def test_split_does_not_parse_in_the_filter(spark):
    raw = spark.createDataFrame([(line(),)], "value string")
    valid, _ = dead_letter_split(decode_requests(raw.repartition(2)))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_responses(spark):
    good = {
        "trace_id": "t",
        "score": 0.5,
        "decision": "allow",
        "reason": [],
        "timings_us": {"parse": 0, "feature": 3, "router": 9, "l1": 2, "l2": 0, "serialize": 1},
    }
    broken = [
        None,
        "oops",
        json.dumps({**good, "timings_us": {"feature": 3}}),
        json.dumps({**good, "score": "high"}),
        json.dumps({**good, "reason": "none"}),
    ]
    rows = [(i, v) for i, v in enumerate([json.dumps(good), *broken])]
    out = decode_responses(spark.createDataFrame(rows, "i int, value string")).orderBy("i").collect()
    assert [r.ok for r in out] == [True] + [False] * len(broken)
    assert (out[0].feature_us, out[0].router_us, out[0].serialize_us) == (3, 9, 1)
    assert all(r.router_us == 0 for r in out[1:])


def test_counters(spark):
    body = "\n".join(
        [
            "# HELP router_l2_trigger_total 9",
            "",
            "router_l2_trigger_total 1",
            "\trouter_l2_trigger_total 2.5 1700000000 \r",
            'router_deadline_miss_total{a="b"} 7',
            "router_l2_skipped_budget_total 3d",
            "router_l2_skipped_budget_total",
            "router_timeout_before_l2_total +1e2",
            "router_timeout_before_l2_total_other 5",
        ]
    )
    row = scrape_counters(spark.createDataFrame([(body,)], "body string")).first()
    assert [row[c] for c in COUNTERS] == [2.5, None, None, 100.0]


def test_levels(spark):
    assert [r.rps for r in rps_levels(spark, start=0, stop=10, step=4).collect()] == [1, 5, 9]
    assert [r.rps for r in rps_levels(spark, " 1000, ,0,2000").collect()] == [1000, 2000]
    specs = spark.createDataFrame([("a",), ("0,,",), ("1,-2",), ("7",)], "s string")
    assert [r[0] for r in specs.select(list_levels(F.col("s"))).collect()] == [None, None, None, [7]]
    with pytest.raises(SparkRuntimeException):
        rps_levels(spark, "1,x").collect()


def test_synthetic_transactions(spark):
    n = 20_000
    tx = synth_transactions(spark, n, seed=7)
    rows = tx.collect()
    again = synth_transactions(spark, n, seed=7).repartition(13).orderBy("arrival_seq").collect()
    assert sorted(rows, key=lambda r: r.arrival_seq) == again
    share = lambda test: sum(map(test, rows)) / n
    assert share(lambda r: r.country == "JP") == pytest.approx(0.92, abs=0.01)
    assert share(lambda r: r.channel == "ecom") == pytest.approx(0.7, abs=0.015)
    assert share(lambda r: r.is_3ds) == pytest.approx(0.6, abs=0.015)
    assert share(lambda r: r.ip_prefix == "198.51.100") == pytest.approx(0.02, abs=0.005)
    assert share(lambda r: r.device_id.endswith("0")) == pytest.approx(0.1, abs=0.01)
    assert set(Counter(r.mcc for r in rows)) == {5411, 5732, 7995, 6011, 4812, 4829, 5311}
    assert min(r.amount for r in rows) == 1.0
    assert sum(r.amount for r in rows) / n == pytest.approx(5000, rel=0.05)
    assert rows != synth_transactions(spark, n, seed=8).collect()

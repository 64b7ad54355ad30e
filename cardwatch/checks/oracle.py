"""SQL on the same tables that must give the rows of each registered query."""

from __future__ import annotations

# Transactions derived from `events`.
_TX = """
SELECT 1704067200000 + (epoch_us(ts) - 1704067200000000) // 1000000
         - CASE WHEN event_id % 101 = 0 THEN 5000 WHEN event_id % 37 = 0 THEN 1500 ELSE 0 END
         AS event_time_ms,
       event_id AS arrival_seq,
       concat('u_', CAST(user_id AS varchar)) AS user_id,
       concat('c_', CAST(user_id AS varchar)) AS card_id,
       concat('m_', CAST(event_id % 2000 + 1 AS varchar)) AS merchant_id,
       CAST(CASE event_id % 7 WHEN 0 THEN 5411 WHEN 1 THEN 5732 WHEN 2 THEN 7995
            WHEN 3 THEN 6011 WHEN 4 THEN 4812 WHEN 5 THEN 4829 ELSE 5311 END AS integer) AS mcc,
       value AS amount,
       'JPY' AS currency,
       CASE WHEN k % 12 = 0 THEN 'US' ELSE 'JP' END AS country,
       CASE WHEN k % 10 < 7 THEN 'ecom' ELSE 'pos' END AS channel,
       concat('d_', CAST(event_id % 2000 + 1 AS varchar)) AS device_id,
       CASE WHEN k % 50 = 0 THEN '198.51.100' ELSE '203.0.113' END AS ip_prefix,
       k % 5 < 3 AS is_3ds,
       (event_id % 12) * 1000 AS elapsed_before_l2_us,
       (event_id % 12) * 1000 + 300 AS elapsed_total_us
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS integer) AS k FROM events)
"""


def _lateness(time: str = "event_time_ms") -> str:
    """CTEs tx and l: running maxima in arrival order and the late flags."""
    return f"""
tx AS ({_TX}),
timed AS (SELECT *, {time} AS t, CAST(floor(({time}) / 100.0) AS bigint) AS b FROM tx),
maxima AS (
  SELECT *,
    max(t) OVER (PARTITION BY user_id ORDER BY arrival_seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm,
    max(b) OVER (PARTITION BY user_id ORDER BY arrival_seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mb
  FROM timed),
l AS (
  SELECT *,
    coalesce(pm > 0 AND t < pm, false) AS late,
    coalesce(pm > 0 AND pm - t > 2000, false) AS severe,
    CAST(CASE WHEN pm > 0 AND t >= pm THEN t - pm ELSE 0 END AS double) AS inter_arrival_ms,
    CAST(CASE WHEN pm > 0 AND t < pm THEN 1 ELSE 0 END AS double) AS oo_order_flag
  FROM maxima)"""


_STORE = f"""{_lateness()},
w AS (
  SELECT i.user_id, i.arrival_seq,
    CAST(count(j.arrival_seq) FILTER (WHERE j.b > i.b - 600) AS double) AS velocity_60s,
    CAST(count(j.arrival_seq) AS double) AS velocity_300s,
    coalesce(sum(j.amount) FILTER (WHERE j.b > i.b - 600), 0) AS amount_sum_60s,
    coalesce(sum(j.amount), 0) AS amount_sum_300s
  FROM l i LEFT JOIN l j
    ON j.user_id = i.user_id AND j.arrival_seq < i.arrival_seq AND NOT j.severe
   AND j.b <= i.b AND j.b > i.mb - 3000
  GROUP BY ALL),
store AS (SELECT l.*, w.* EXCLUDE (user_id, arrival_seq)
          FROM l JOIN w USING (user_id, arrival_seq))"""

_FEATURES = f"""{_STORE},
f AS (
  SELECT * REPLACE (CAST(is_3ds AS double) AS is_3ds),
    ln(greatest(amount, 0.01::double)) AS amount_log,
    CASE WHEN country <> 'JP' THEN 1.0::double ELSE 0 END AS is_foreign,
    CASE mcc WHEN 7995 THEN 1.0::double WHEN 6011 THEN 0.8 WHEN 4829 THEN 0.6 ELSE 0.2 END AS mcc_risk,
    CASE WHEN ends_with(device_id, '0') THEN 1.0::double ELSE 0 END AS device_risky,
    CASE WHEN starts_with(ip_prefix, '198.') THEN 1.0::double ELSE 0 END AS ip_risky
  FROM store)"""

_S1 = """1 / (1 + exp(-(-2.0::double + 0.8::double * amount_log + 1.2::double * is_foreign
    + 0.15::double * velocity_60s + 0.6::double * device_risky + 0.4::double * ip_risky)))"""
_S2 = """1 / (1 + exp(-(-1.5::double + 0.7::double * amount_log + 1.0::double * is_foreign
    + 0.08::double * velocity_300s + 0.002::double * amount_sum_300s
    - 0.0003::double * inter_arrival_ms + 0.9::double * mcc_risk - 0.8::double * is_3ds)))"""


def _scored(limited: bool = True) -> str:
    before, total = ("elapsed_before_l2_us", "elapsed_total_us") if limited else ("0", "0")
    return f"""{_FEATURES},
s AS (SELECT *, {_S1} AS s1, {_S2} AS s2 FROM f),
r AS (
  SELECT *, CASE WHEN NOT (s1 > 0.35::double AND s1 < 0.65::double) THEN 'none'
                 WHEN {before} >= 10000 THEN 'timeout_before_l2'
                 WHEN 10000 - {before} <= 1000 THEN 'skipped_budget'
                 ELSE 'l2' END AS route FROM s),
x AS (SELECT *, CASE WHEN route = 'l2' THEN s2 ELSE s1 END AS score FROM r),
scored AS (
  SELECT *, CASE WHEN {total} > 10000 THEN 'degrade_allow' WHEN score >= 0.85::double THEN 'deny'
                 WHEN score >= 0.65::double THEN 'manual_review' ELSE 'allow' END AS decision FROM x)"""


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_WINDOWS = ("velocity_60s", "velocity_300s", "amount_sum_60s", "amount_sum_300s")
_VECTOR = (
    "amount_log", "is_foreign", "mcc_risk", "device_risky", "ip_risky", "is_3ds",
    *_WINDOWS, "inter_arrival_ms", "oo_order_flag",
)
_UUID = "'3f2b8c1e-9a47-4d16-8e55-0b7c6d2a1f90'"
_TRACE = """concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '4' || substr(h, 14, 3),
    '8' || substr(h, 18, 3), substr(h, 21, 12))"""
_HASH = "md5(CAST(arrival_seq AS varchar)) AS h"


def _tx(select: str) -> str:
    return f"WITH tx AS ({_TX}) SELECT arrival_seq, {select} FROM tx"


def _late(select: str, where: str = "true") -> str:
    return f"WITH {_lateness()} SELECT user_id, arrival_seq, {select} FROM l WHERE {where}"


def _u(field: str) -> str:
    return (
        f"(('0x' || substr(md5(concat_ws('|', '42', CAST(event_id AS varchar), '{field}')), 1, 8))"
        "::bigint / 4294967296.0::double)"
    )


def _pick(field: str, n: int) -> str:
    return f"CAST(floor({_u(field)} * {n}) AS bigint)"


_SYNTH = f"""
SELECT event_id AS arrival_seq,
  1704067200000 + event_id AS event_time_ms,
  'u_' || ({_pick('user', 10000)} + 1) AS user_id,
  'c_' || ({_pick('card', 50000)} + 1) AS card_id,
  'm_' || ({_pick('merchant', 2000)} + 1) AS merchant_id,
  CAST(list_extract([5411, 5732, 7995, 6011, 4812, 4829, 5311], {_pick('mcc', 7)} + 1) AS integer) AS mcc,
  round(greatest(pow({_u('amount')}, 3) * 20000, 1.0::double), 6) AS amount,
  'JPY' AS currency,
  CASE WHEN {_u('country')} < 0.92::double THEN 'JP' ELSE 'US' END AS country,
  CASE WHEN {_u('channel')} < 0.7::double THEN 'ecom' ELSE 'pos' END AS channel,
  'd_' || ({_pick('device', 2000)} + 1) AS device_id,
  CASE WHEN {_u('ip')} < 0.02::double THEN '198.51.100' ELSE '203.0.113' END AS ip_prefix,
  {_u('is_3ds')} < 0.6::double AS is_3ds
FROM events"""

# Load-test tables derived from `events`.
_LOAD = """
lev AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS runtime,
               1000 * (1 + (event_id // 2) % 8) AS rps FROM events),
e AS (SELECT *, CAST(floor(value * 100 * (CASE WHEN rps >= 6000 THEN 2 ELSE 1 END)) AS bigint) AS e2e_us
      FROM lev),
samples AS (SELECT event_id, runtime, rps,
  event_type <> 'error' AND NOT (runtime = 'a' AND rps = 3000) AS ok, event_id % 3 = 0 AS used_l2,
  e2e_us, e2e_us // 2 AS feature_us, e2e_us // 4 AS router_us, e2e_us // 8 AS l1_us,
  CASE WHEN event_id % 3 = 0 THEN e2e_us // 16 ELSE 0 END AS l2_us, event_id % 5 AS serialize_us
  FROM e WHERE NOT (runtime = 'b' AND rps = 8000)),
ticks AS (SELECT runtime, rps, CAST(floor(value * 20000) AS bigint) AS lag_ns FROM lev),
levels AS (SELECT runtime, rps,
  CAST(sum(CASE WHEN rps >= 7000 AND value > 250 THEN 1 ELSE 0 END) AS bigint) AS dropped
  FROM lev GROUP BY ALL),
counters AS (SELECT event_id, runtime, rps, CAST(event_id AS double) AS router_l2_trigger_total,
  CASE WHEN event_id % 2 = 0 THEN event_id + 0.5::double END AS router_deadline_miss_total,
  pow(10.0::double, event_id % 4) AS router_l2_skipped_budget_total,
  CAST(NULL AS double) AS router_timeout_before_l2_total FROM lev)"""


def _ranked(name: str, source: str, by: str, value: str, ps: tuple[int, ...]) -> str:
    """CTE: exact nearest-rank percentiles per group."""
    at = ", ".join(
        f"max(CASE WHEN rn = CAST(round(CAST({p} / 100.0 AS double) * (n - 1)) AS bigint) "
        f"THEN {value} END) AS p{p}"
        for p in ps
    )
    return f"""
{name} AS (SELECT {by}, {at}, max(n) AS n, CAST(sum({value}) AS bigint) AS total,
    min({value}) AS min, max({value}) AS max
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS rn,
               count(*) OVER (PARTITION BY {by}) AS n FROM {source})
  GROUP BY {by})"""


_STAGES = ("feature", "router", "l1", "l2", "serialize")
_SUMMARY = f"""{_LOAD},
good AS (SELECT * FROM samples WHERE ok),
lags AS (SELECT *, lag_ns // 1000 AS lag_us FROM ticks),
{_ranked('e2e_rank', 'good', 'runtime, rps', 'e2e_us', (50, 95, 99))},
{', '.join(_ranked(f'{m}_rank', 'good', 'runtime, rps', f'{m}_us', (99,)) for m in _STAGES)},
{_ranked('lag_rank', 'lags', 'runtime, rps', 'lag_us', (99,))},
missed AS (SELECT runtime, rps,
  CAST(coalesce(sum(CASE WHEN lag_ns > 1000000000 // rps THEN lag_ns // (1000000000 // rps) END), 0)
       AS bigint) AS missed_ticks_total FROM ticks GROUP BY ALL),
seen AS (SELECT runtime, rps, max(router_l2_trigger_total) AS router_l2_trigger_total,
  max(router_deadline_miss_total) AS router_deadline_miss_total,
  max(router_l2_skipped_budget_total) AS router_l2_skipped_budget_total,
  max(router_timeout_before_l2_total) AS router_timeout_before_l2_total
  FROM counters GROUP BY ALL),
totals AS (SELECT runtime, rps, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS err
  FROM samples GROUP BY ALL),
summary AS (
  SELECT runtime, rps, coalesce(ok, 0) AS ok, coalesce(err, 0) AS err,
    {', '.join(f'coalesce(e2e_rank.p{p}, 0) AS p{p}_us' for p in (50, 95, 99))},
    {', '.join(f'coalesce({m}_rank.p99, 0) AS {m}_p99_us' for m in _STAGES)},
    levels.dropped, lag_rank.p99 AS bench_lag_p99_us, lag_rank.max AS bench_lag_max_us,
    missed.missed_ticks_total, seen.* EXCLUDE (runtime, rps)
  FROM (SELECT DISTINCT runtime, rps FROM lev) LEFT JOIN totals USING (runtime, rps)
  LEFT JOIN e2e_rank USING (runtime, rps)
  {' '.join(f'LEFT JOIN {m}_rank USING (runtime, rps)' for m in _STAGES)}
  JOIN levels USING (runtime, rps) JOIN lag_rank USING (runtime, rps)
  JOIN missed USING (runtime, rps) JOIN seen USING (runtime, rps)),
prev AS (SELECT *, last_value(CASE WHEN ok > 0 AND dropped = 0 THEN p99_us END IGNORE NULLS) OVER (
    PARTITION BY runtime ORDER BY rps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_p99_us
  FROM summary),
judged AS (SELECT *, CASE WHEN dropped > 0 THEN 'dropped ' || dropped
    WHEN ok > 0 AND prev_p99_us > 0 AND p99_us > CAST(round(prev_p99_us * 1.3::double) AS bigint)
     AND p99_us > prev_p99_us + 200 THEN concat_ws(' ', 'p99', prev_p99_us, 'to', p99_us) END AS reason
  FROM prev)"""

_SUMMARY_NUMBERS = (
    "rps", "ok", "err", "dropped", "p50_us", "p95_us", "p99_us", *[f"{m}_p99_us" for m in _STAGES],
    "bench_lag_p99_us", "bench_lag_max_us", "missed_ticks_total",
)
_COUNTERS = (
    "router_l2_trigger_total", "router_deadline_miss_total", "router_l2_skipped_budget_total",
    "router_timeout_before_l2_total",
)
_ROUTER = """count(*) FILTER (WHERE route = 'l2') AS router_l2_trigger_total,
  count(*) FILTER (WHERE decision = 'degrade_allow') AS router_deadline_miss_total,
  count(*) FILTER (WHERE route = 'skipped_budget') AS router_l2_skipped_budget_total,
  count(*) FILTER (WHERE route = 'timeout_before_l2') AS router_timeout_before_l2_total"""
_EVIDENCE = (
    ("amount_log", 6.5, 6.5),
    ("velocity_60s", 4.0, 4.0),
    ("is_foreign", 1.0, 0.5),
    ("mcc_risk", 0.8, 0.8),
)
_ITEMS = "CAST(CASE WHEN route = 'l2' THEN 5 ELSE 4 END AS integer) AS items"
_STORE_ROWS = f"""WITH {_STORE} SELECT user_id, arrival_seq, {_round(*_WINDOWS)},
  inter_arrival_ms, oo_order_flag FROM store"""
_CLAMP = "least(event_time_ms, event_time_ms - CASE WHEN arrival_seq % 3 = 0 THEN 90000 ELSE 30000 END + 60000)"
_RESPONSES = f"""WITH {_scored()}, t AS (SELECT *, {_HASH} FROM scored)
  SELECT {_TRACE} AS trace_id, {_round('score')}, decision, {_ITEMS} FROM t"""


def _distribution(stage: str, us: str) -> str:
    bounds = (1_000, 5_000, 10_000)
    counts = [
        f"count(*) FILTER (WHERE {us} <= {high} AND {us} > {low}) AS {stage}_le_{high}us"
        for low, high in zip((-1, *bounds), bounds)
    ]
    return ", ".join(
        [
            f"count({us}) AS {stage}_n",
            f"CAST(sum({us}) AS bigint) AS {stage}_sum_us",
            f"min({us}) AS {stage}_min_us",
            f"max({us}) AS {stage}_max_us",
            *counts,
            f"count(*) FILTER (WHERE {us} > 10000) AS {stage}_gt_10000us",
        ]
    )


def _evidence() -> str:
    items = [
        f"SELECT arrival_seq, CAST({i} AS integer) AS pos, '{s}' AS signal, round({s}, 6) AS value, "
        f"{baseline}::double AS baseline_p95, "
        f"CASE WHEN {s} > {limit}::double THEN 'risk_up' ELSE 'risk_down' END AS direction FROM scored"
        for i, (s, baseline, limit) in enumerate(_EVIDENCE)
    ]
    items.append(
        "SELECT arrival_seq, CAST(4 AS integer), 'layer2_used', 1.0::double, 1.0::double, 'info' "
        "FROM scored WHERE route = 'l2'"
    )
    return f"WITH {_scored()} " + " UNION ALL ".join(items)


def _long(values: str, source: str) -> str:
    return f"WITH {_FEATURES} " + " UNION ALL ".join(
        f"SELECT arrival_seq, '{v}' AS name, round({v}, 6) AS value FROM f" for v in _VECTOR
    )


def _model(expression: str) -> str:
    return f"WITH {_FEATURES} SELECT arrival_seq, round({expression}, 6) AS score FROM f"


_SPLITS = """1 / (1 + exp(-(-0.5::double
    + CASE WHEN amount_log > 2.5 THEN 0.6::double ELSE -0.4 END
    + CASE WHEN velocity_300s > 0.5 THEN 0.7::double ELSE -0.2 END
    + CASE WHEN mcc_risk > 0.5 THEN 1.1::double ELSE 0.1 END
    + CASE WHEN is_3ds > 0.5 THEN -0.9::double ELSE 0.9 END)))"""
_RISK_TABLE = f"""WITH tx AS ({_TX}), risks AS (
  SELECT mcc, round(count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS double), 6) AS risk
  FROM tx JOIN events ON event_id = arrival_seq GROUP BY mcc)
  SELECT arrival_seq, CASE WHEN risk > 0 AND mcc <> 5411 THEN risk ELSE 0.2::double END AS mcc_risk
  FROM tx JOIN risks USING (mcc)"""
_SIGNALS = ", ".join(f"CASE WHEN {s} > {limit}::double THEN '{s}' END" for s, _, limit in _EVIDENCE)
_DEAD = f"""WITH tx AS ({_TX}), c AS (
  SELECT *, CASE arrival_seq % 16 WHEN 0 THEN 'channel' WHEN 1 THEN 'missing: amount'
    WHEN 2 THEN 'type: amount' WHEN 3 THEN 'range: mcc' WHEN 4 THEN 'syntax'
    WHEN 7 THEN 'trace_id' WHEN 8 THEN 'type: user_id' WHEN 10 THEN 'type: mcc'
    WHEN 11 THEN 'range: amount' WHEN 13 THEN 'trace_id' ELSE 'valid' END AS cause FROM tx)
  SELECT arrival_seq, cause, CASE WHEN cause = 'valid' THEN user_id END AS user_id,
    CASE WHEN cause = 'valid' THEN CASE WHEN arrival_seq % 16 = 6 THEN 5 ELSE amount END END AS amount,
    CASE WHEN arrival_seq % 16 IN (9, 12, 14) THEN {_UUID} END AS trace_id
  FROM c"""


def oracle_sql() -> dict[str, str]:
    request = (
        "event_time_ms, user_id, card_id, merchant_id, mcc, amount, currency, country, channel, "
        "device_id, ip_prefix, is_3ds"
    )
    stage_values = " UNION ALL ".join(
        f"SELECT '{m}' AS stage, {m}_us AS us FROM samples" + (" WHERE used_l2" if m == "l2" else "")
        for m in ("e2e", *_STAGES)
    )
    return {
        "score_transactions": f"""WITH {_scored()} SELECT user_id, arrival_seq,
            {_round('velocity_60s', 'velocity_300s', 'amount_sum_300s', 's1', 'score')},
            route, decision, concat_ws(',', {_SIGNALS}) AS signals FROM scored""",
        "decode_requests": _tx(f"CAST(NULL AS varchar) AS cause, {request}"),
        "dead_letter_split": _DEAD,
        "synth_transactions": _SYNTH,
        "decode_responses": """SELECT event_id AS arrival_seq, event_id % 10 > 3 AS ok,
            CASE WHEN event_id % 10 > 3 THEN event_id % 97 ELSE 0 END AS feature_us,
            CASE WHEN event_id % 10 > 3 THEN event_id % 89 ELSE 0 END AS router_us,
            CASE WHEN event_id % 10 > 3 THEN event_id % 83 ELSE 0 END AS l1_us,
            CASE WHEN event_id % 10 > 3 THEN event_id % 79 ELSE 0 END AS l2_us,
            CAST(CASE WHEN event_id % 10 > 3 THEN 1 ELSE 0 END AS bigint) AS serialize_us
            FROM events""",
        "scrape_counters": f"WITH {_LOAD} SELECT * EXCLUDE (runtime, rps) FROM counters",
        "sink_scored": _RESPONSES,
        "sink_bench_csv": f"""WITH {_SUMMARY} SELECT '1700000000000' AS ts_ms, runtime,
            CASE runtime WHEN 'a' THEN 'http://x/score?a=1,"b"' ELSE 'http://y/score' END AS url,
            CASE runtime WHEN 'a' THEN 'http://x/metrics' ELSE 'http://y/metrics' END AS metrics_url,
            '20' AS duration_s, '200' AS concurrency,
            {', '.join(f"CAST({c} AS varchar) AS {c}" for c in _SUMMARY_NUMBERS)},
            {', '.join(f"printf('%.0f', {c}) AS {c}" for c in _COUNTERS)}
            FROM summary""",
        "trace_id": f"""WITH tx AS (SELECT *, {_HASH} FROM ({_TX})) SELECT arrival_seq,
            CASE WHEN arrival_seq % 2 = 0 THEN {_UUID} ELSE {_TRACE} END AS trace_id FROM tx""",
        "amount_log": _tx("round(ln(greatest(amount - 20, 0.01::double)), 6) AS amount_log"),
        "is_foreign": _tx("CASE WHEN country = 'JP' THEN 0.0::double ELSE 1 END AS is_foreign"),
        "mcc_risk": _tx(
            "CASE mcc WHEN 7995 THEN 1.0::double WHEN 6011 THEN 0.8 WHEN 4829 THEN 0.6 "
            "ELSE 0.2 END AS mcc_risk"
        ),
        "mcc_risk_table": _RISK_TABLE,
        "mcc_risk_shuffled": _RISK_TABLE,
        "device_risky": _tx("CAST(device_id LIKE '%0' AS integer)::double AS device_risky"),
        "ip_risky": _tx("CAST(ip_prefix LIKE '198.%' AS integer)::double AS ip_risky"),
        "is_3ds_num": _tx("CAST(is_3ds AS integer)::double AS is_3ds"),
        "future_clamp": _tx(f"{_CLAMP} AS time_ms"),
        "bucketize": _tx(
            "CAST(floor((event_time_ms - 1705000000000) / 100.0) AS bigint) AS bucket"
        ),
        "sigmoid": _tx("round(1 / (1 + exp(-((amount - 50) / 20))), 6) AS p"),
        "clamp01": _tx("round(least(greatest((amount - 20) / 50, 0), 1), 6) AS x"),
        "feature_vector": f"WITH {_FEATURES} SELECT arrival_seq, {_round(*_VECTOR)} FROM f",
        "feature_long": _long("name", "f"),
        "reasons": _evidence(),
        "scored_record": f"""WITH {_scored()}, t AS (SELECT *, {_HASH} FROM scored)
            SELECT user_id, {_TRACE} AS trace_id, {_round('score')}, decision, {_ITEMS} FROM t""",
        "linear_score": _model(_S1),
        "linear_score_long": f"""WITH {_FEATURES}
            SELECT arrival_seq, 'l1' AS model, round({_S1}, 6) AS score FROM f
            UNION ALL SELECT arrival_seq, 'l2', round({_S2}, 6) FROM f""",
        "score_l1": _model(_S1),
        "score_l2": _model(_S2),
        "uncertain_band": f"""WITH {_scored()}
            SELECT arrival_seq, s1 > 0.35::double AND s1 < 0.65::double AS uncertain FROM scored""",
        "cascade_route": f"""WITH {_scored(limited=False)}
            SELECT arrival_seq, route, {_round('s1', 'score')}, decision FROM scored""",
        "cascade_model": f"""WITH {_scored()}, m AS (SELECT arrival_seq, route, elapsed_total_us AS us,
              CASE WHEN route = 'l2' THEN {_SPLITS} END AS s2, s1 FROM scored),
            n AS (SELECT *, coalesce(s2, s1) AS score FROM m)
            SELECT arrival_seq, route, {_round('s2', 'score')}, CASE WHEN us > 10000 THEN 'degrade_allow'
              WHEN score >= 0.85::double THEN 'deny' WHEN score >= 0.65::double THEN 'manual_review'
              ELSE 'allow' END AS decision FROM n""",
        "budget_route": f"WITH {_scored()} SELECT arrival_seq, route FROM scored",
        "decide": f"WITH {_scored()} SELECT arrival_seq, {_round('score')}, decision FROM scored",
        "prev_max_time": _late("pm AS prev_max_time_ms"),
        "max_bucket_seen": _late("mb AS max_bucket_seen"),
        "inter_arrival": _late("inter_arrival_ms"),
        "late_flag": _late("oo_order_flag"),
        "severe_late": _late("severe AS severe_late"),
        "accepted_updates": _late("b AS bucket", "NOT severe"),
        "bucket_preagg": f"""WITH {_lateness()} SELECT user_id, b AS bucket, count(*) AS cnt,
            round(sum(amount), 6) AS amount_sum FROM l WHERE NOT severe GROUP BY user_id, b""",
        "expiry": f"""WITH {_lateness()} SELECT i.user_id, i.arrival_seq,
              i.mb - 2999 AS oldest_bucket, count(j.arrival_seq) AS dropped_n,
              round(coalesce(sum(j.amount), 0), 6) AS dropped_amount
            FROM l i LEFT JOIN l j
              ON j.user_id = i.user_id AND j.arrival_seq < i.arrival_seq AND NOT j.severe
             AND j.b <= i.b AND j.b > i.b - 3000 AND j.b < i.mb - 2999
            GROUP BY ALL""",
        **{
            w: f"WITH {_STORE} SELECT user_id, arrival_seq, {_round(w)} FROM store"
            for w in _WINDOWS
        },
        "store_features": _STORE_ROWS,
        "store_features_segmented": _STORE_ROWS,
        "router_counters": f"WITH {_scored()} SELECT {_ROUTER} FROM scored",
        "router_counters_by_hour": f"""WITH {_scored()} SELECT event_time_ms // 3600000 AS hour,
            {_ROUTER} FROM scored GROUP BY hour""",
        "stage_histograms": f"""WITH {_LOAD}, v AS ({stage_values}),
            {_ranked('h', 'v', 'stage', 'us', (50, 95, 99))} SELECT * FROM h""",
        "nearest_rank_percentile": f"""WITH {_LOAD},
            {_ranked('h', 'samples', 'runtime, rps', 'e2e_us', (50, 95, 99))}
            SELECT runtime, rps, n, p50, p95, p99 FROM h""",
        "bench_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
        "bench_lag": f"WITH {_SUMMARY} SELECT runtime, rps, bench_lag_p99_us, bench_lag_max_us FROM summary",
        "missed_ticks": f"WITH {_SUMMARY} SELECT * FROM missed",
        "decision_mix": f"WITH {_scored()} SELECT decision, count(*) AS n FROM scored GROUP BY decision",
        "prev_level_p99": f"WITH {_SUMMARY} SELECT runtime, rps, p99_us, prev_p99_us FROM prev",
        "knee_reasons": f"WITH {_SUMMARY} SELECT runtime, rps, reason FROM judged",
        "find_knee": f"""WITH {_SUMMARY}, k AS (SELECT min(rps) AS knee_rps FROM judged
            WHERE reason IS NOT NULL)
            SELECT runtime, rps, p99_us, prev_p99_us, reason, knee_rps FROM judged, k
            WHERE knee_rps IS NULL OR rps <= knee_rps""",
        "rps_levels": """WITH p AS (SELECT event_id,
              CAST(regexp_extract(props, '([0-9]+)', 1) AS integer) AS k FROM events)
            SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN k = 0 THEN '2000'
                ELSE (k * 10) || ',2000' END AS listed,
              array_to_string(range(greatest(k, 1), 101, 25), ',') AS ranged
            FROM p""",
        "compare_targets": f"""WITH {_SUMMARY} SELECT rps,
            max(p99_us) FILTER (WHERE runtime = 'a') AS p99_a,
            max(p99_us) FILTER (WHERE runtime = 'b') AS p99_b FROM summary GROUP BY rps""",
        "stream_store_features": _STORE_ROWS,
        "stream_state": f"""WITH {_lateness()}, newest AS (SELECT user_id, max(b) AS mb FROM l GROUP BY user_id)
            SELECT user_id, b AS bucket, count(*) AS cnt, round(sum(amount), 6) AS amount_sum
            FROM l JOIN newest USING (user_id) WHERE NOT severe AND b >= newest.mb - 2999
            GROUP BY user_id, b""",
        "stream_score": f"""WITH {_scored(limited=True)}, t AS (SELECT *, {_HASH} FROM scored)
            SELECT {_TRACE} AS trace_id, {_round('score')}, decision, {_ITEMS} FROM t""",
        "stream_future_clamp": f"""WITH {_lateness(_CLAMP)}
            SELECT user_id, arrival_seq, inter_arrival_ms, oo_order_flag FROM l""",
        "stream_metrics": f"""WITH {_scored()} SELECT event_time_ms // 60000 * 60000
            AS window_start_ms, {_ROUTER}, {_distribution('before', 'elapsed_before_l2_us')},
            {_distribution('total', 'elapsed_total_us')} FROM scored GROUP BY window_start_ms""",
        "stream_dead_letters": f"""SELECT cause, count(*) AS n, count(*) AS numbers
            FROM ({_DEAD}) WHERE cause <> 'valid' GROUP BY cause""",
    }

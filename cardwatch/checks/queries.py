"""One query per operator, each over whole tables: name -> (spark, sf_dir) -> rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch import sinks
from cardwatch.config import Config
from cardwatch.functions import features as X
from cardwatch.functions import scoring as S
from cardwatch.models import Stump, default_models, stump_model, weights_table
from cardwatch.operators import knee, load_stats
from cardwatch.operators.expiry import expired
from cardwatch.operators.features import feature_long, feature_vector, with_row_features
from cardwatch.operators.linear_long import linear_score_long
from cardwatch.operators.lookup import BROADCAST_CODES, mcc_risk_lookup
from cardwatch.operators.windows import (
    accepted,
    bucket_preagg,
    store_features,
    with_lateness,
)
from cardwatch.plans.score import score_transactions, scored_features
from cardwatch.schemas import FEATURES, REQUEST, RESPONSE
from cardwatch.sources import levels as level_lists
from cardwatch.sources import tables
from cardwatch.sources.counters import COUNTERS, scrape_counters
from cardwatch.sources.requests import dead_letter_split, decode_requests, encode_requests
from cardwatch.sources.responses import decode_responses
from cardwatch.sources.synth import synth_from_ids
from cardwatch.streaming import checks as stream_checks

Query = Callable[[SparkSession, str], DataFrame]
CFG = Config()
MODELS = default_models()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "events")


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return tables.transactions(_events(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return store_features(with_row_features(_tx(spark, d)), CFG)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_features(_tx(spark, d), MODELS, CFG)


def _unlimited(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d).drop("elapsed_before_l2_us", "elapsed_total_us")
    return scored_features(tx, MODELS, CFG)


def _r(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _row(name: str, column: Callable[[], Column]) -> Query:
    # Columns need a running session; the registry itself must not.
    return lambda s, d: _tx(s, d).select("arrival_seq", column().alias(name))


# Scans, sources, sinks -------------------------------------------------------


def decode(spark, d):
    decoded = decode_requests(encode_requests(_tx(spark, d)))
    names = [f.name for f in REQUEST.fields if f.name != "trace_id"]
    return decoded.select("arrival_seq", "cause", *names)


def dead_letters(spark, d):
    valid, dead = dead_letter_split(decode_requests(tables.faulty_requests(_tx(spark, d))))
    return valid.select(
        "arrival_seq", F.lit("valid").alias("cause"), "user_id", "amount", "trace_id"
    ).unionByName(dead.select("arrival_seq", "cause"), allowMissingColumns=True)


def synth(spark, d):
    ids = _events(spark, d).select(F.col("event_id").alias("id"))
    return synth_from_ids(ids).drop("trace_id").withColumn("amount", F.round("amount", 6))


def responses(spark, d):
    scored = score_transactions(_tx(spark, d), MODELS, CFG, repeatable_ids=True)
    timings = F.struct(
        F.lit(0).cast("long").alias("parse"),
        *[
            (F.col("arrival_seq") % m).alias(stage)
            for stage, m in (("feature", 97), ("router", 89), ("l1", 83), ("l2", 79))
        ],
        F.lit(1).cast("long").alias("serialize"),
    )
    line = F.to_json(F.struct("trace_id", "score", "decision", "reason", timings.alias("timings_us")))
    fault = F.col("arrival_seq") % 10
    value = (
        F.when(fault == 0, None)
        .when(fault == 1, F.expr("left(line, 40)"))
        .when(fault == 2, F.regexp_replace("line", '"l2":[0-9]+', '"l2":-1'))
        .when(fault == 3, F.regexp_replace("line", '"decision":"[a-z_]+",', ""))
        .otherwise(F.col("line"))
    )
    log = scored.withColumn("line", line).select("arrival_seq", value.alias("value"))
    return decode_responses(log).drop("value")


def counters(spark, d):
    return scrape_counters(tables.scrapes(_events(spark, d))).select("event_id", *COUNTERS)


def scored_file(spark, d):
    path = sinks.shared_folder(spark)
    sinks.sink_scored(score_transactions(_tx(spark, d), MODELS, CFG, repeatable_ids=True), path)
    back = spark.read.schema(RESPONSE).json(path)
    return back.select("trace_id", _r("score"), "decision", F.size("reason").alias("items"))


def summary_file(spark, d):
    path = sinks.shared_folder(spark)
    urls = {
        "a": ('http://x/score?a=1,"b"', "http://x/metrics"),
        "b": ("http://y/score", "http://y/metrics"),
    }
    rows = sinks.summary_rows(_summary(spark, d), F.lit(1_700_000_000_000), urls)
    sinks.sink_bench_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


# Row features and scores -----------------------------------------------------


def clamp(spark, d):
    # Ingest 30 s before the event of every third row is 90 s behind: clamped.
    behind = F.when(F.col("arrival_seq") % 3 == 0, 90_000).otherwise(30_000)
    tx = _tx(spark, d).withColumn("ingest_time_ms", F.col("event_time_ms") - behind)
    time = X.event_time(F.col("event_time_ms"), F.col("ingest_time_ms"), CFG)
    return tx.select("arrival_seq", time.alias("time_ms"))


def negative_buckets(spark, d):
    shifted = F.col("event_time_ms") - 1_705_000_000_000
    return _tx(spark, d).select("arrival_seq", X.bucket(shifted, CFG).alias("bucket"))


def sigmoid_of(spark, d):
    z = (F.col("amount") - 50) / 20
    return _tx(spark, d).select("arrival_seq", F.round(S.sigmoid(z), 6).alias("p"))


def clamp01_of(spark, d):
    return _tx(spark, d).select(
        "arrival_seq", F.round(S.clamp01((F.col("amount") - 20) / 50), 6).alias("x")
    )


def trace_ids(spark, d):
    given = F.when(F.col("arrival_seq") % 2 == 0, F.lit("3f2b8c1e-9a47-4d16-8e55-0b7c6d2a1f90"))
    return _tx(spark, d).select(
        "arrival_seq", X.trace_id(given, F.col("arrival_seq")).alias("trace_id")
    )


def vector(spark, d):
    f = feature_vector(_features(spark, d), "arrival_seq")
    return f.select("arrival_seq", *[_r(c) for c in FEATURES])


def vector_long(spark, d):
    return feature_long(_features(spark, d), "arrival_seq").withColumn("value", F.round("value", 6))


def evidence(spark, d):
    items = _scored(spark, d).select(
        "arrival_seq", F.posexplode("reason").alias("pos", "item")
    )
    return items.select(
        "arrival_seq",
        "pos",
        "item.signal",
        F.round("item.value", 6).alias("value"),
        "item.baseline_p95",
        "item.direction",
    )


def record(spark, d):
    r = score_transactions(_tx(spark, d), MODELS, CFG, repeatable_ids=True)
    return r.select(
        "user_id", "trace_id", _r("score"), "decision", F.size("reason").alias("items")
    )


def linear(spark, d):
    # A model with a feature that does not exist: it adds nothing.
    model = replace(MODELS.l1, weights=(*MODELS.l1.weights, ("no_such_feature", 5.0)))
    f = _features(spark, d)
    return f.select("arrival_seq", F.round(S.linear_score(model, f.columns), 6).alias("score"))


def linear_long(spark, d):
    long = feature_long(_features(spark, d), "arrival_seq")
    rows = _events(spark, d).count()
    scores = linear_score_long(long, weights_table(spark, MODELS), ["arrival_seq"], rows)
    return scores.withColumn("score", F.round("score", 6))


def layer(model) -> Query:
    def run(spark, d):
        f = _features(spark, d)
        return f.select("arrival_seq", F.round(S.linear_score(model, f.columns), 6).alias("score"))

    return run


def band(spark, d):
    return _scored(spark, d).select("arrival_seq", S.in_band(F.col("s1"), CFG).alias("uncertain"))


def cascade(spark, d):
    return _unlimited(spark, d).select("arrival_seq", "route", _r("s1"), _r("score"), "decision")


def cascade_model(spark, d):
    """The cascade with a second model that is no weighted sum."""
    second = stump_model(
        "splits",
        -0.5,
        (
            Stump("amount_log", 2.5, -0.4, 0.6),
            Stump("velocity_300s", 0.5, -0.2, 0.7),
            Stump("mcc_risk", 0.5, 0.1, 1.1),
            Stump("is_3ds", 0.5, 0.9, -0.9),
        ),
    )
    scored = scored_features(_tx(spark, d), replace(MODELS, l2=second), CFG)
    return scored.select("arrival_seq", "route", _r("s2"), _r("score"), "decision")


def risk_table(broadcast_codes: int) -> Query:
    """Risk of a category: its share of failed events; one code is left out of the table."""

    def run(spark, d):
        events = _events(spark, d)
        tx = tables.transactions(events).select("arrival_seq", "mcc", "amount")
        failed = events.select(
            F.col("event_id").alias("arrival_seq"), (F.col("event_type") == "error").alias("failed")
        )
        risks = (
            tx.join(failed, "arrival_seq")
            .groupBy("mcc")
            .agg(F.round(F.count_if("failed") / F.count("*"), 6).alias("risk"))
            .filter("risk > 0 AND mcc <> 5411")
        )
        rated = mcc_risk_lookup(tx, risks, broadcast_codes=broadcast_codes)
        return rated.select("arrival_seq", "mcc_risk")

    return run


def budget(spark, d):
    return _scored(spark, d).select("arrival_seq", "route")


def decision(spark, d):
    return _scored(spark, d).select("arrival_seq", _r("score"), "decision")


def flagship(spark, d):
    """Every transaction scored, with route, decision and its rising signals."""
    up = F.filter("reason", lambda item: item["direction"] == "risk_up")
    signals = F.array_join(F.transform(up, lambda item: item["signal"]), ",")
    return _scored(spark, d).select(
        "user_id",
        "arrival_seq",
        *[_r(c) for c in ("velocity_60s", "velocity_300s", "amount_sum_300s", "s1", "score")],
        "route",
        "decision",
        signals.alias("signals"),
    )


# Windows ---------------------------------------------------------------------


def late(*columns: str) -> Query:
    return lambda s, d: with_lateness(_tx(s, d), CFG).select("user_id", "arrival_seq", *columns)


def held(spark, d):
    return accepted(_tx(spark, d), CFG).select("user_id", "arrival_seq", "bucket")


def buckets(spark, d):
    return bucket_preagg(accepted(_tx(spark, d), CFG)).withColumn(
        "amount_sum", F.round("amount_sum", 6)
    )


def expiry(spark, d):
    """Oldest bucket kept at each row, and what the bound drops from the row's own window."""
    rows = expired(_tx(spark, d).select("user_id", "arrival_seq", "event_time_ms", "amount"), CFG)
    return rows.select(
        "user_id", "arrival_seq", "oldest_bucket", "dropped_n", _r("dropped_amount")
    )


def window(name: str) -> Query:
    return lambda s, d: store_features(_tx(s, d), CFG).select("user_id", "arrival_seq", _r(name))


def store(cfg: Config) -> Query:
    names = ("velocity_60s", "velocity_300s", "amount_sum_60s", "amount_sum_300s")
    return lambda s, d: store_features(_tx(s, d), cfg).select(
        "user_id", "arrival_seq", *[_r(c) for c in names], "inter_arrival_ms", "oo_order_flag"
    )


# Load statistics -------------------------------------------------------------


def _summary(spark, d):
    e = _events(spark, d)
    return load_stats.bench_summary(
        tables.samples(e), tables.ticks(e), tables.levels(e), tables.scrapes(e)
    )


def _p99(spark, d):
    e = _events(spark, d)
    return load_stats.bench_summary(tables.samples(e), levels=tables.levels(e))


def percentiles(spark, d):
    s = tables.samples(_events(spark, d))
    return load_stats.nearest_rank(s, ["runtime", "rps"], "e2e_us", (50, 95, 99)).select(
        "runtime", "rps", "n", "p50", "p95", "p99"
    )


def knee_rows(spark, d):
    return knee.find_knee(_p99(spark, d)).select(
        "runtime", "rps", "p99_us", "prev_p99_us", "reason", "knee_rps"
    )


def sweep(spark, d):
    """Level lists of both kinds, written from every event."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    listed = F.concat(
        F.lit(" "), (k * 10).cast("string"), F.lit(" ,, 0,"),
        F.when(F.col("event_id") % 5 == 0, "x").otherwise("2000"),
    )
    ranged = level_lists.range_levels(k, F.lit(100), F.lit(25))
    return _events(spark, d).select(
        "event_id",
        F.array_join(level_lists.list_levels(listed).cast("array<string>"), ",").alias("listed"),
        F.array_join(ranged.cast("array<string>"), ",").alias("ranged"),
    )


def targets(spark, d):
    return knee.compare_targets(_p99(spark, d), ["a", "b"]).withColumnsRenamed(
        {"a": "p99_a", "b": "p99_b"}
    )


def queries() -> dict[str, Query]:
    return {
        "score_transactions": flagship,
        # sources and sinks
        "decode_requests": decode,
        "dead_letter_split": dead_letters,
        "synth_transactions": synth,
        "decode_responses": responses,
        "scrape_counters": counters,
        "sink_scored": scored_file,
        "sink_bench_csv": summary_file,
        # row features
        "trace_id": trace_ids,
        "amount_log": _row("amount_log", lambda: F.round(X.amount_log(F.col("amount") - 20), 6)),
        "is_foreign": _row("is_foreign", lambda: X.is_foreign(F.col("country"))),
        "mcc_risk": _row("mcc_risk", lambda: X.mcc_risk(F.col("mcc"))),
        "mcc_risk_table": risk_table(BROADCAST_CODES),
        # The same rows with a table that counts as too large to broadcast.
        "mcc_risk_shuffled": risk_table(0),
        "device_risky": _row("device_risky", lambda: X.device_risky(F.col("device_id"))),
        "ip_risky": _row("ip_risky", lambda: X.ip_risky(F.col("ip_prefix"))),
        "is_3ds_num": _row("is_3ds", lambda: F.col("is_3ds").cast("double")),
        "future_clamp": clamp,
        "bucketize": negative_buckets,
        "sigmoid": sigmoid_of,
        "clamp01": clamp01_of,
        "feature_vector": vector,
        "feature_long": vector_long,
        "reasons": evidence,
        "scored_record": record,
        # scores and routing
        "linear_score": linear,
        "linear_score_long": linear_long,
        "score_l1": layer(MODELS.l1),
        "score_l2": layer(MODELS.l2),
        "uncertain_band": band,
        "cascade_route": cascade,
        "cascade_model": cascade_model,
        "budget_route": budget,
        "decide": decision,
        # windows
        "prev_max_time": late("prev_max_time_ms"),
        "max_bucket_seen": late("max_bucket_seen"),
        "inter_arrival": late("inter_arrival_ms"),
        "late_flag": late("oo_order_flag"),
        "severe_late": late("severe_late"),
        "accepted_updates": held,
        "bucket_preagg": buckets,
        "expiry": expiry,
        "velocity_60s": window("velocity_60s"),
        "velocity_300s": window("velocity_300s"),
        "amount_sum_60s": window("amount_sum_60s"),
        "amount_sum_300s": window("amount_sum_300s"),
        "store_features": store(CFG),
        # The same rows with every user treated as heavy.
        "store_features_segmented": store(replace(CFG, heavy_rows=0, segment_rows=16)),
        # aggregations
        "router_counters": lambda s, d: load_stats.router_counters(_scored(s, d)),
        "router_counters_by_hour": lambda s, d: load_stats.router_counters(
            _scored(s, d), X.floor_div(F.col("event_time_ms"), 3_600_000).alias("hour")
        ),
        "stage_histograms": lambda s, d: load_stats.stage_histograms(
            tables.samples(_events(s, d))
        ),
        "nearest_rank_percentile": percentiles,
        "bench_summary": _summary,
        "bench_lag": lambda s, d: load_stats.bench_lag(tables.ticks(_events(s, d))),
        "missed_ticks": lambda s, d: load_stats.missed_ticks(tables.ticks(_events(s, d))),
        "decision_mix": lambda s, d: load_stats.decision_mix(_scored(s, d)),
        # ordered analytics
        "prev_level_p99": lambda s, d: knee.prev_level_p99(_p99(s, d)).select(
            "runtime", "rps", "p99_us", "prev_p99_us"
        ),
        "knee_reasons": lambda s, d: knee.knee_reasons(_p99(s, d)).select(
            "runtime", "rps", "reason"
        ),
        "find_knee": knee_rows,
        "rps_levels": sweep,
        "compare_targets": targets,
        # streaming
        **stream_checks.queries(),
    }

"""Explicit schemas; nothing in the engine infers one."""

from __future__ import annotations

from pyspark.sql import types as T

# The request contract.
REQUEST = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("event_time_ms", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("mcc", T.IntegerType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_prefix", T.StringType()),
        T.StructField("is_3ds", T.BooleanType()),
    ]
)
REQUIRED = tuple(f.name for f in REQUEST.fields if f.name != "trace_id")
CHANNELS = ("pos", "ecom", "atm", "transfer")
DECISIONS = ("allow", "manual_review", "deny", "degrade_allow")

# The response contract.
REASON = T.StructType(
    [
        T.StructField("signal", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("baseline_p95", T.DoubleType()),
        T.StructField("direction", T.StringType()),
    ]
)
STAGES = ("parse", "feature", "router", "l1", "l2", "serialize")
TIMINGS = T.StructType([T.StructField(s, T.LongType()) for s in STAGES])
RESPONSE = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.ArrayType(REASON)),
        T.StructField("timings_us", TIMINGS),
    ]
)

# Order of the feature vector.
FEATURES = (
    "amount_log",
    "is_foreign",
    "mcc_risk",
    "device_risky",
    "ip_risky",
    "is_3ds",
    "velocity_60s",
    "velocity_300s",
    "amount_sum_60s",
    "amount_sum_300s",
    "inter_arrival_ms",
    "oo_order_flag",
)

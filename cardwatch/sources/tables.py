"""Transactions and load-test tables derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the test adapter.
_EPOCH_MS = 1_704_067_200_000
_MCCS = (5411, 5732, 7995, 6011, 4812, 4829, 5311)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(events: DataFrame) -> DataFrame:
    """`events` as transactions: time runs 1000 times faster, some rows come late."""
    eid = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    # events.ts has no time zone; counting from the epoch keeps the session's out of it.
    since_epoch = F.expr("ts - timestamp_ntz'1970-01-01 00:00:00'")
    seconds = F.floor(since_epoch.cast("interval second").cast("decimal(24,6)")).cast("long")
    mcc = F.element_at(F.array(*[F.lit(m) for m in _MCCS]), (eid % 7 + 1).cast("int"))
    late = F.when(eid % 101 == 0, 5000).when(eid % 37 == 0, 1500).otherwise(0)
    return events.select(
        (_EPOCH_MS + seconds - _EPOCH_MS // 1000 - late).alias("event_time_ms"),
        eid.alias("arrival_seq"),
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("c_"), F.col("user_id").cast("string")).alias("card_id"),
        F.concat(F.lit("m_"), (eid % 2000 + 1).cast("string")).alias("merchant_id"),
        mcc.alias("mcc"),
        F.col("value").alias("amount"),
        F.lit("JPY").alias("currency"),
        F.when(k % 12 == 0, "US").otherwise("JP").alias("country"),
        F.when(k % 10 < 7, "ecom").otherwise("pos").alias("channel"),
        F.concat(F.lit("d_"), (eid % 2000 + 1).cast("string")).alias("device_id"),
        F.when(k % 50 == 0, "198.51.100").otherwise("203.0.113").alias("ip_prefix"),
        (k % 5 < 3).alias("is_3ds"),
        ((eid % 12) * 1000).alias("elapsed_before_l2_us"),
        ((eid % 12) * 1000 + 300).alias("elapsed_total_us"),
    )


def faulty_requests(tx: DataFrame) -> DataFrame:
    """Request lines of all transactions, with a fault planted by arrival number."""
    line = F.to_json(F.struct(*[c for c in tx.columns if c not in _NOT_SENT]))
    fault = F.col("arrival_seq") % 16

    def swap(pattern: str, new: str) -> Column:
        return F.regexp_replace(line, pattern, new)

    value = (
        F.when(fault == 0, swap('"channel":"[a-z]+"', '"channel":"ECOM"'))
        .when(fault == 1, swap('"amount":[^,]+,', ""))
        .when(fault == 2, swap('"amount":[^,]+,', '"amount":"x",'))
        .when(fault == 3, swap('"mcc":[0-9]+', '"mcc":99999999999'))
        .when(fault == 4, F.lit("{bad"))
        .when(fault == 5, swap("^\\{", '{"unknown":[1,{"user_id":2}],'))
        .when(fault == 6, swap('"amount":[^,]+,', '"amount":5,'))
        .when(fault == 7, swap("^\\{", '{"trace_id":"not-an-id",'))
        .when(fault == 8, swap('"user_id":"u_', '"user_id":7,"was":"'))
        .when(fault == 9, swap("^\\{", '{"trace_id":"3f2b8c1e-9a47-4d16-8e55-0b7c6d2a1f90",'))
        .when(fault == 10, swap('("mcc":[0-9]+)', "$1.0"))
        .when(fault == 11, swap('"amount":[^,]+,', '"amount":1e400,'))
        .when(fault == 12, swap("^\\{", '{"trace_id":"{3F2B8C1E-9a47-4d16-8e55-0b7c6d2a1f90}",'))
        .when(fault == 13, swap("^\\{", '{"trace_id":"3f2b8c1e9a474d16-8e55-0b7c6d2a1f90",'))
        .when(fault == 14, swap("^\\{", '{"trace_id":"urn:uuid:3f2b8c1e-9a47-4d16-8e55-0b7c6d2a1f90",'))
        .otherwise(line)
    )
    return tx.select("arrival_seq", value.alias("value"))


_NOT_SENT = ("arrival_seq", "elapsed_before_l2_us", "elapsed_total_us")


def _level(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    half = F.floor(eid / 2)
    return events.withColumns(
        {
            "runtime": F.when(eid % 2 == 0, "a").otherwise("b"),
            "rps": (1000 * (1 + half % 8)).cast("long"),
        }
    )


def samples(events: DataFrame) -> DataFrame:
    """Recorded latencies: one sample per event, slower from 6000 requests/s on.

    Nothing came back of runtime b at 8000, and only failures of runtime a at 3000.
    """
    lost = (F.col("runtime") == "b") & (F.col("rps") == 8000)
    failed = (F.col("runtime") == "a") & (F.col("rps") == 3000)
    e2e = F.floor(F.col("value") * 100 * F.when(F.col("rps") >= 6000, 2).otherwise(1))
    return (
        _level(events)
        .filter(~lost)
        .withColumn("e2e_us", e2e.cast("long"))
        .select(
            "event_id",
            "runtime",
            "rps",
            ((F.col("event_type") != "error") & ~failed).alias("ok"),
            (F.col("event_id") % 3 == 0).alias("used_l2"),
            "e2e_us",
            *[
                F.floor(F.col("e2e_us") / part).cast("long").alias(f"{stage}_us")
                for stage, part in (("feature", 2), ("router", 4), ("l1", 8))
            ],
            F.when(F.col("event_id") % 3 == 0, F.floor(F.col("e2e_us") / 16))
            .otherwise(0)
            .cast("long")
            .alias("l2_us"),
            (F.col("event_id") % 5).alias("serialize_us"),
        )
    )


def ticks(events: DataFrame) -> DataFrame:
    lag = F.floor(F.col("value") * 20_000).cast("long")
    return _level(events).select(
        "runtime", "rps", F.col("event_id").alias("seq"), lag.alias("lag_ns")
    )


def levels(events: DataFrame) -> DataFrame:
    dropped = F.when((F.col("rps") >= 7000) & (F.col("value") > 250), 1).otherwise(0)
    return _level(events).groupBy("runtime", "rps").agg(
        F.sum(dropped).cast("long").alias("dropped")
    )


def scrapes(events: DataFrame) -> DataFrame:
    """A counter dump per event, with lines that must be skipped."""
    eid = F.col("event_id").cast("string")
    lines = F.concat_ws(
        "\n",
        F.lit("# TYPE router_l2_trigger_total counter"),
        F.lit("router_l2_trigger_total 1"),
        F.lit(""),
        F.concat(F.lit("  router_l2_trigger_total   "), eid, F.lit("  ")),
        F.concat(F.lit('router_deadline_miss_total{runtime="a"} '), eid),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("router_deadline_miss_total "), eid, F.lit(".5"))),
        F.concat(F.lit("router_l2_skipped_budget_total 1e"), (F.col("event_id") % 4).cast("string")),
        F.lit("router_l2_skipped_budget_total many"),
        F.lit("router_timeout_before_l2_total"),
        F.concat(F.lit("e2e_us_count "), eid),
    )
    return _level(events).select("event_id", "runtime", "rps", lines.alias("body"))

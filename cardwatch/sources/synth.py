"""Synthetic transactions with the load test's distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Distributions of the load test.
USERS, CARDS, MERCHANTS, DEVICES = 10_000, 50_000, 2_000, 2_000
MCCS = (5411, 5732, 7995, 6011, 4812, 4829, 5311)
AMOUNT_SCALE, AMOUNT_POWER, AMOUNT_MIN = 20_000.0, 3.0, 1.0
SHARE_JP, SHARE_ECOM, SHARE_3DS, SHARE_RISKY_IP = 0.92, 0.7, 0.6, 0.02


def uniform(seed: int, row: Column, field: str) -> Column:
    """A number in [0, 1) that depends on seed, row and field only, not on partitions."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(field)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def synth_from_ids(
    ids: DataFrame, seed: int = 42, start_ms: int = 1_704_067_200_000, rps: int = 1_000
) -> DataFrame:
    """One transaction per row of `ids` (column `id`, also the arrival number)."""
    row = F.col("id")

    def u(field: str) -> Column:
        return uniform(seed, row, field)

    def pick(field: str, n: int) -> Column:
        return F.floor(u(field) * n).cast("long")

    def name(prefix: str, field: str, n: int) -> Column:
        return F.concat(F.lit(prefix), (pick(field, n) + 1).cast("string"))

    mcc = F.element_at(F.array(*[F.lit(m) for m in MCCS]), (pick("mcc", len(MCCS)) + 1).cast("int"))
    amount = F.greatest(F.pow(u("amount"), F.lit(AMOUNT_POWER)) * AMOUNT_SCALE, F.lit(AMOUNT_MIN))
    return ids.select(
        row.alias("arrival_seq"),
        F.lit(None).cast("string").alias("trace_id"),
        (F.lit(start_ms) + F.floor(row * 1000 / rps)).cast("long").alias("event_time_ms"),
        name("u_", "user", USERS).alias("user_id"),
        name("c_", "card", CARDS).alias("card_id"),
        name("m_", "merchant", MERCHANTS).alias("merchant_id"),
        mcc.alias("mcc"),
        amount.alias("amount"),
        F.lit("JPY").alias("currency"),
        F.when(u("country") < SHARE_JP, "JP").otherwise("US").alias("country"),
        F.when(u("channel") < SHARE_ECOM, "ecom").otherwise("pos").alias("channel"),
        name("d_", "device", DEVICES).alias("device_id"),
        F.when(u("ip") < SHARE_RISKY_IP, "198.51.100").otherwise("203.0.113").alias("ip_prefix"),
        (u("is_3ds") < SHARE_3DS).alias("is_3ds"),
    )


def synth_transactions(
    spark: SparkSession,
    n: int,
    seed: int = 42,
    start_ms: int = 1_704_067_200_000,
    rps: int = 1_000,
) -> DataFrame:
    return synth_from_ids(spark.range(n), seed, start_ms, rps)

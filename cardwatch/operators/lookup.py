"""Category risks from a table instead of a fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.functions.features import MCC_RISK_OTHER

#: Codes of a table that are broadcast at most, some 30 MB of them; beyond that rows are
#: shuffled by code.
BROADCAST_CODES = 500_000
#: Parts that the rows of one code are dealt to in that shuffle.
SPREAD = 32


def mcc_risk_lookup(
    tx: DataFrame,
    risks: DataFrame,
    other: float = MCC_RISK_OTHER,
    broadcast_codes: int = BROADCAST_CODES,
) -> DataFrame:
    """The rows with `mcc_risk` from a table (mcc, risk); `other` for codes not in it.

    Of several risks of one code the largest counts; null codes and null risks count
    nowhere. The table is counted first: up to `broadcast_codes` codes are broadcast, more
    are joined by a shuffle in which a code that many rows have is dealt to several tasks,
    also on a stream. `risks` itself must be no stream. An `mcc_risk` that the rows had is
    replaced.
    """
    tx = tx.drop("mcc_risk")
    table = (
        risks.filter("mcc IS NOT NULL AND risk IS NOT NULL")
        .groupBy(F.col("mcc").alias("_code"))
        .agg(F.max(F.col("risk").cast("double")).alias("_risk"))
    )
    if table.limit(broadcast_codes + 1).count() <= broadcast_codes:
        joined = tx.join(F.broadcast(table), F.col("mcc") == F.col("_code"), "left")
    else:
        parts = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        dealt = tx.withColumn("_deal", F.pmod(F.xxhash64(*tx.columns), F.lit(SPREAD)).cast("int"))
        same = (F.col("mcc") == F.col("_code")) & (F.col("_deal") == F.col("_part"))
        joined = dealt.join(parts.hint("merge"), same, "left").drop("_deal", "_part")
    risk = F.coalesce("_risk", F.lit(other))
    return joined.withColumn("mcc_risk", risk).drop("_code", "_risk")

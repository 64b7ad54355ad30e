"""The twelve-value feature vector, wide and long."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.functions import features as X
from cardwatch.operators.lookup import mcc_risk_lookup
from cardwatch.schemas import FEATURES


def with_row_features(tx: DataFrame, mcc_risks: DataFrame | None = None) -> DataFrame:
    """Adds the six signals that need only the row itself, or the table of category risks.

    `is_3ds` becomes a number. Applying this before the shuffle by user lets
    the strings it reads be pruned from the shuffled rows.
    """
    rated = tx.withColumn("mcc_risk", X.mcc_risk(F.col("mcc")))
    if mcc_risks is not None:
        rated = mcc_risk_lookup(tx, mcc_risks)
    return rated.withColumns(
        {
            "amount_log": X.amount_log(F.col("amount")),
            "is_foreign": X.is_foreign(F.col("country")),
            "device_risky": X.device_risky(F.col("device_id")),
            "ip_risky": X.ip_risky(F.col("ip_prefix")),
            "is_3ds": F.col("is_3ds").cast("double"),
        }
    )


def feature_vector(features: DataFrame, *keep: str) -> DataFrame:
    return features.select(*keep, *FEATURES)


def feature_long(features: DataFrame, *keep: str) -> DataFrame:
    """One (name, value) row per feature."""
    return features.unpivot(list(keep), list(FEATURES), "name", "value")

"""Linear scores with the weights kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.functions.scoring import clamp01, sigmoid
from cardwatch.models import BIAS
from cardwatch.operators.spread import spread


def linear_score_long(
    features: DataFrame, weights: DataFrame, row: list[str], rows: int = 0
) -> DataFrame:
    """Scores (row..., model, score) from (row..., name, value) and a weights table.

    A row's few features are brought together once, by one shuffle, and get the
    bias term; so a row without any matching feature still has every model's
    score. Of features with the same name the first counts: by `position`, if the
    table has that column, then by value. How the weights are joined is Spark's choice.

    rows: how many rows (not features) there are, as far as known. Where they ask for more
    tasks than shuffles have anyway, they get them, so memory does not grow with the table.
    """
    position = F.col("position") if "position" in features.columns else F.lit(0)
    term = F.struct(position.alias("position"), "value", "name")
    bias = F.struct(F.lit(BIAS).alias("name"), F.lit(1.0).alias("value"))
    names = F.transform("terms", lambda t: t["name"])
    first = F.filter("terms", lambda t, i: F.array_position(F.col("names"), t["name"]) == i + 1)
    pairs = F.transform("first", lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value")))
    terms = (
        spread(features, rows, *row)
        .groupBy(*row)
        .agg(F.array_sort(F.collect_list(term)).alias("terms"))
        .withColumn("names", names)
        .select(*row, first.alias("first"))
        .select(*row, F.inline(F.array_append(pairs, bias)))
    )
    weighted = terms.join(weights, F.col("name") == F.col("feature"))
    z = F.sum(F.col("weight") * F.col("value"))
    return weighted.groupBy(*row, "model").agg(clamp01(sigmoid(z)).alias("score"))

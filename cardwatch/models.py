"""Models as data: linear ones by their weights, any other as a function on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Scores of the rows of a batch that has a column per feature.
BatchScore = Callable[[pa.RecordBatch], pa.Array]


@dataclass(frozen=True)
class LinearModel:
    name: str
    bias: float
    weights: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class ArrowModel:
    """A second model of any form.

    `load` is called once a task, there, and returns the scoring function. That function
    gets the rows that the cascade sends to this model and no others, as doubles.
    """

    name: str
    load: Callable[[], BatchScore]


@dataclass(frozen=True)
class Models:
    l1: LinearModel
    l2: LinearModel | ArrowModel


@dataclass(frozen=True)
class Stump:
    """One split: adds `above` where the feature exceeds the threshold, else `below`."""

    feature: str
    threshold: float
    below: float
    above: float


def stump_model(name: str, bias: float, stumps: tuple[Stump, ...]) -> ArrowModel:
    """Boosted one-split trees as a second model: sigmoid of the bias plus all splits."""

    def load() -> BatchScore:
        def score(rows: pa.RecordBatch) -> pa.Array:
            z = np.full(len(rows), bias)
            for s in stumps:
                x = rows[s.feature].to_numpy(zero_copy_only=False)
                z = z + np.where(x > s.threshold, s.above, s.below)
            return pa.array(1.0 / (1.0 + np.exp(-z)))

        return score

    return ArrowModel(name, load)


def default_models() -> Models:
    # Default bias and weights, in the order they are added up.
    return Models(
        l1=LinearModel(
            "l1",
            -2.0,
            (
                ("amount_log", 0.8),
                ("is_foreign", 1.2),
                ("velocity_60s", 0.15),
                ("device_risky", 0.6),
                ("ip_risky", 0.4),
            ),
        ),
        l2=LinearModel(
            "l2",
            -1.5,
            (
                ("amount_log", 0.7),
                ("is_foreign", 1.0),
                ("velocity_300s", 0.08),
                ("amount_sum_300s", 0.002),
                ("inter_arrival_ms", -0.0003),
                ("mcc_risk", 0.9),
                ("is_3ds", -0.8),
            ),
        ),
    )


# The bias is a weight on a feature that every row has with value 1.
BIAS = "(bias)"


def weights_table(spark: SparkSession, models: Models) -> DataFrame:
    """Weights of the linear models as rows (model, feature, weight)."""
    rows = [
        (m.name, feature, weight)
        for m in (models.l1, models.l2)
        if isinstance(m, LinearModel)
        for feature, weight in ((BIAS, m.bias), *m.weights)
    ]
    return spark.createDataFrame(rows, "model string, feature string, weight double")

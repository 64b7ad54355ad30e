"""Scores, cascade routing, decisions and evidence as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from cardwatch.config import Config
from cardwatch.models import ArrowModel, LinearModel


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def linear_score(model: LinearModel, columns: list[str]) -> Column:
    """Probability of one model; terms without a column add nothing."""
    terms = [F.lit(w) * F.col(f) for f, w in model.weights if f in columns]
    return clamp01(sigmoid(reduce(lambda z, term: z + term, terms, F.lit(model.bias))))


def routed_score(model: LinearModel | ArrowModel, columns: list[str], asked: Column) -> Column:
    """Probability of a model on the rows that ask for it, null on the others.

    A linear model is an expression. Of the rows for an Arrow model only those that ask
    carry features; they are gathered from each batch, scored and put back in place. A score
    that such a model leaves null is NaN.
    """
    if isinstance(model, LinearModel):
        # CASE is lazy: the model is evaluated only on its route.
        return F.when(asked, linear_score(model, columns))
    features = F.struct(*[F.col(f).cast("double").alias(f) for f in columns])
    return _gathered(model)(F.when(asked, features))


def _gathered(model: ArrowModel):
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.load()
        for rows in batches:
            asked = rows.is_valid()
            some = rows.filter(asked)
            out = pa.nulls(len(rows), pa.float64())
            if len(some):
                found = score(pa.RecordBatch.from_struct_array(some))
                if len(found) != len(some):
                    raise ValueError(f"{model.name}: {len(found)} scores for {len(some)} rows")
                inside = np.clip(found.cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, 1.0)
                out = pc.replace_with_mask(out, asked, pa.array(inside))
            yield out

    # Filters above must not repeat the model's work below them.
    return run.asNondeterministic()


def in_band(s1: Column, cfg: Config) -> Column:
    return (s1 > cfg.l1_uncertain_low) & (s1 < cfg.l1_uncertain_high)


def route(s1: Column, elapsed_us: Column | None, cfg: Config) -> Column:
    """What happens to the second model: none, l2, skipped_budget or timeout_before_l2."""
    spent = F.lit(0) if elapsed_us is None else F.coalesce(elapsed_us, F.lit(0))
    return (
        F.when(~in_band(s1, cfg), "none")
        .when(spent >= cfg.budget_us, "timeout_before_l2")
        .when(cfg.budget_us - spent <= cfg.l2_reserve_us, "skipped_budget")
        .otherwise("l2")
    )


def final_score(route_: Column, s1: Column, s2: Column) -> Column:
    return F.when(route_ == "l2", s2).otherwise(s1)


def decide(score: Column, elapsed_us: Column | None, cfg: Config) -> Column:
    spent = F.lit(0) if elapsed_us is None else F.coalesce(elapsed_us, F.lit(0))
    return (
        F.when(spent > cfg.budget_us, "degrade_allow")
        # Spark ranks NaN above all numbers; here it reaches no threshold.
        .when(F.isnan(score), "allow")
        .when(score >= cfg.deny_threshold, "deny")
        .when(score >= cfg.review_threshold, "manual_review")
        .otherwise("allow")
    )


# Evidence items (signal, baseline_p95, raises risk above), in order.
EVIDENCE = (
    ("amount_log", 6.5, 6.5),
    ("velocity_60s", 4.0, 4.0),
    ("is_foreign", 1.0, 0.5),
    ("mcc_risk", 0.8, 0.8),
)


def reasons(used_l2: Column) -> Column:
    """Evidence array; one more item when the second model decided."""

    def item(signal: str, value: Column, baseline: float, direction: Column) -> Column:
        return F.struct(
            F.lit(signal).alias("signal"),
            value.alias("value"),
            F.lit(baseline).alias("baseline_p95"),
            direction.alias("direction"),
        )

    def above(value: Column, limit: float) -> Column:
        return (value > limit) & ~F.isnan(value)

    base = [
        item(s, F.col(s), baseline, F.when(above(F.col(s), limit), "risk_up").otherwise("risk_down"))
        for s, baseline, limit in EVIDENCE
    ]
    second = item("layer2_used", F.lit(1.0), 1.0, F.lit("info"))
    return F.when(used_l2, F.array(*base, second)).otherwise(F.array(*base))

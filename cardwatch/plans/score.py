"""Transactions to scored transactions, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import Config
from cardwatch.functions import features as X
from cardwatch.functions import scoring as S
from cardwatch.models import Models, default_models
from cardwatch.operators.features import with_row_features
from cardwatch.operators.windows import store_features
from cardwatch.schemas import FEATURES, STAGES


def with_scores(features: DataFrame, models: Models, cfg: Config) -> DataFrame:
    """Adds s1, s2, route, score, decision and reason to feature rows."""
    columns = list(FEATURES)
    before_l2 = _optional(features, "elapsed_before_l2_us")
    total = _optional(features, "elapsed_total_us")
    return (
        features.withColumn("s1", S.linear_score(models.l1, columns))
        .withColumn("route", S.route(F.col("s1"), before_l2, cfg))
        .withColumn("s2", S.routed_score(models.l2, columns, F.col("route") == "l2"))
        .withColumn("score", S.final_score(F.col("route"), F.col("s1"), F.col("s2")))
        .withColumn("decision", S.decide(F.col("score"), total, cfg))
        .withColumn("reason", S.reasons(F.col("route") == "l2"))
    )


def scored_features(
    tx: DataFrame,
    models: Models | None = None,
    cfg: Config = Config(),
    mcc_risks: DataFrame | None = None,
) -> DataFrame:
    """Every transaction with features, both scores, route, decision and evidence.

    mcc_risks: a table (mcc, risk) in place of the default one, see `mcc_risk_lookup`.
    """
    features = store_features(slim(with_row_features(tx, mcc_risks)), cfg)
    return with_scores(features, models or default_models(), cfg)


def score_transactions(
    tx: DataFrame,
    models: Models | None = None,
    cfg: Config = Config(),
    repeatable_ids: bool = False,
) -> DataFrame:
    """Transactions to responses: trace_id, score, decision, reason, timings_us."""
    return scored_record(scored_features(tx, models, cfg), repeatable_ids)


def scored_record(scored: DataFrame, repeatable_ids: bool = False) -> DataFrame:
    arrival = F.col("arrival_seq") if repeatable_ids else None
    timings = _optional(scored, "timings_us")
    if timings is None:
        timings = F.struct(*[F.lit(0).cast("long").alias(s) for s in STAGES])
    return scored.select(
        "user_id",
        "arrival_seq",
        X.trace_id(_optional(scored, "trace_id"), arrival).alias("trace_id"),
        "score",
        "decision",
        "reason",
        timings.alias("timings_us"),
    )


def slim(tx: DataFrame, *keep: str) -> DataFrame:
    """Only what scoring reads, and `keep`, travels through the shuffle by user."""
    wanted = (
        "user_id",
        "arrival_seq",
        "event_time_ms",
        "ingest_time_ms",
        "amount",
        "trace_id",
        "timings_us",
        "elapsed_before_l2_us",
        "elapsed_total_us",
        *FEATURES,
        *keep,
    )
    return tx.select(*[c for c in tx.columns if c in wanted])


def _optional(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None

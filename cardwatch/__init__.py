"""cardwatch: payment-transaction risk scoring as Spark jobs, batch and stream."""

from cardwatch.config import Config
from cardwatch.models import LinearModel, Models, default_models
from cardwatch.plans.score import score_transactions
from cardwatch.streaming.score import stream_score

__all__ = [
    "Config",
    "LinearModel",
    "Models",
    "default_models",
    "score_transactions",
    "stream_score",
]

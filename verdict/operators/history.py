"""The model comparison table (R11) of the append-only metrics history (K2, U4).

A run appends its metric rows by ``sources.sinks.append_history``; the latest row per model is a ``max_by`` aggregate,
partial-aggregated map side, so a model with a long history is never
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_model(history: DataFrame, *, model: str, ts: str) -> DataFrame:
    others = [c for c in history.columns if c != model]
    best = F.max_by(F.struct(*others), F.col(ts))
    return history.groupBy(model).agg(best.alias("_r")).select(model, "_r.*")

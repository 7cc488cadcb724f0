"""Sinks (K1-K6): table writes, append-only history, nested statistics
JSON, vector stores, metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """K1 (and K4 with ``mode='append'``)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_history(metrics: DataFrame, path: str) -> None:
    """K2/U4: one row per run, stamped with the wall clock (F15, not part of
    any compared result); appended, never rewritten."""
    metrics.withColumn("run_ts", F.current_timestamp()).write.mode("append").parquet(path)


def write_stats_json(stats: DataFrame, path: str) -> None:
    """K3: nested statistics (overall + per category) as JSON lines."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """K5/K6: metric rows ``(k | metric, value)`` as a table."""
    metrics.write.mode("overwrite").parquet(path)

"""Keys that write and read back: result stores of whole runs and the resumable enrichment."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators.history import latest_per_model
from ..operators.metrics import confusion, report
from ..session import checkpoint_dir, cut_lineage
from ..sources.runlog import append_run, read_runs
from ..streaming.incremental import OUT_SCHEMA, enrich_pending
from .bindings import sql_neighbours
from .q_metrics import _SQL_CC, _nn1
from .registry import Tables, register


def _new_store(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("metric_tables", f"""WITH {sql_neighbours(1)},
d AS (SELECT q_label AS y, c_label AS p FROM nn), {_SQL_CC},
r AS (SELECT 'precision' AS stat, cls::VARCHAR AS key, precision::DOUBLE AS value FROM pc
  UNION ALL SELECT 'recall', cls::VARCHAR, recall FROM pc
  UNION ALL SELECT 'f1', cls::VARCHAR, f1 FROM pc
  UNION ALL SELECT 'support', cls::VARCHAR, support FROM pc
  UNION ALL SELECT 'accuracy', 'all', sum(tp) / sum(support) FROM pc
  UNION ALL SELECT 'macro_precision', 'all', avg(precision) FROM pc
  UNION ALL SELECT 'macro_recall', 'all', avg(recall) FROM pc
  UNION ALL SELECT 'macro_f1', 'all', avg(f1) FROM pc
  UNION ALL SELECT 'weighted_precision', 'all', sum(precision * support) / sum(support) FROM pc
  UNION ALL SELECT 'weighted_recall', 'all', sum(recall * support) / sum(support) FROM pc
  UNION ALL SELECT 'weighted_f1', 'all', sum(f1 * support) / sum(support) FROM pc
  UNION ALL SELECT 'micro_precision', 'all', sum(tp) / sum(npred) FROM pc
  UNION ALL SELECT 'micro_recall', 'all', sum(tp) / sum(support) FROM pc
  UNION ALL SELECT 'micro_f1', 'all', 2 * sum(tp) / (sum(support) + sum(npred)) FROM pc)
SELECT 'report' AS name, 'verification' AS run, key, stat, round(value, 6) AS value FROM r
UNION ALL SELECT 'f1', 'verification', key, stat, round(value, 6) FROM r WHERE stat IN ('macro_f1', 'micro_f1', 'weighted_f1')
UNION ALL SELECT 'confusion', 'verification', y::VARCHAR || '>' || p::VARCHAR, 'n', n FROM conf""", "K5 K6 A9 A15 A16")
def q_metric_tables(spark, sf_dir):
    pairs = cut_lineage(_nn1(spark, sf_dir))   # three tables come of it
    rep = report(pairs, "y", "p").select(F.col("cls").alias("key"), F.col("metric").alias("stat"), "value")
    cells = confusion(pairs, "y", "p").select(
        F.concat_ws(">", "truth", "pred").alias("key"), F.lit("n").alias("stat"), F.col("n").cast("double").alias("value"))
    tables = {"report": rep, "f1": rep.filter(F.col("stat").isin("macro_f1", "micro_f1", "weighted_f1")), "confusion": cells}
    path = _new_store(spark, "metric-tables")
    for _ in range(2):   # the repeated run is there once
        append_run(path, "verification", tables)
    back = [read_runs(spark, path, name, "key string, stat string, value double").withColumn("name", F.lit(name))
            for name in tables]
    return back[0].unionByName(back[1]).unionByName(back[2]).select("name", "run", "key", "stat", "value")


_HISTORY = "model string, run_day date, n long, mean_value double"


@register("metrics_history_store", """WITH h AS (SELECT 'user_' || user_id AS model, ts::DATE AS run_day,
        count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id, ts::DATE)
SELECT model, max(run_day) AS run_day, arg_max(n, run_day) AS n, arg_max(mean_value, run_day) AS mean_value,
       'weekday_' || dayofweek(max(run_day)) AS run, count(*) AS n_rows FROM h GROUP BY model""", "K2 U4 R11 F15")
def q_metrics_history_store(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    h = ev.groupBy("user_id", F.to_date("ts").alias("run_day")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    h = cut_lineage(h.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("model"), "run_day", "n", "mean_value"))
    path = _new_store(spark, "metrics-history")
    for day in (*range(7), 3):   # a run for each day of the week, one of them repeated
        append_run(path, f"weekday_{day}", {"history": h.filter(F.dayofweek("run_day") == day + 1)})
    rows = read_runs(spark, path, "history", _HISTORY)
    last = latest_per_model(rows.select("model", "run_day", "n", "mean_value", "run"), model="model", ts="run_day")
    return last.join(rows.groupBy("model").agg(F.count("*").alias("n_rows")), "model")


def source_captions(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a captioning model: the image here is the document's source."""
    image = batch["image"]
    return pd.DataFrame({"id": batch["id"], "caption": ("image of " + image.astype("object")).where(image.notna(), None)})


@register("enrichment_run", """WITH d AS (SELECT doc_id AS id, text, 'image of ' || source AS caption,
         row_number() OVER (PARTITION BY doc_id ORDER BY text NULLS FIRST, source NULLS FIRST) AS nth
       FROM documents WHERE doc_id IS NOT NULL)
SELECT id, coalesce(caption, '') AS caption,
       CASE WHEN length(caption) > 0 THEN text || '. ' || caption ELSE text END AS enriched FROM d WHERE nth = 1""",
          "R1 X2 J14 K4 P9b")
def q_enrichment_run(spark, sf_dir):
    t = Tables(spark, sf_dir)
    claims = t.documents.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("image"))
    path = _new_store(spark, "enriched")
    seen = t.labels.select(F.col("doc_id").alias("id")).distinct()
    enrich_pending(claims.join(seen, "id", "left_semi"), path, source_captions)   # a job that got so far
    enrich_pending(claims, path, source_captions)                                # is resumed
    return spark.read.schema(OUT_SCHEMA).parquet(path)

"""Classification metrics over a ``(truth, prediction)`` table: accuracy (A9),
weighted / macro / micro F1 (A10, A12), per-class P/R/F1 (A11),
classification report (A16), confusion matrix (A15), weighted accuracy
(A13), per-category accuracy (A14), label universe (U6), mean cross-entropy
(A21, A22), count windows (W5) and best-so-far selection (W6).

The data is reduced once to confusion counts (one row per (truth, pred)
cell, partial-aggregated map side); every metric is derived from that tiny
table, so the cost is one pass over the input whatever the metric family.
F1 with a zero denominator is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """A15 long form: (by..., truth, pred, n) for every non-empty cell."""
    by = by or []
    return (df.groupBy(*by, F.col(y).alias("truth"), F.col(p).alias("pred"))
            .agg(F.count("*").alias("n")))


def full_matrix(conf: DataFrame, classes: list[str]) -> DataFrame:
    """A15 with the empty cells: every (truth, pred) of ``classes`` has its row,
    0 where nothing falls; other cells of ``conf`` stay."""
    cells = conf.sparkSession.createDataFrame([(t, p) for t in classes for p in classes], "truth string, pred string")
    return (cells.join(conf, ["truth", "pred"], "full")
            .select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n")))


def class_counts(conf: DataFrame, by: list[str] | None = None,
                 classes: DataFrame | None = None) -> DataFrame:
    """Per class: tp, support (true count), predicted count. The class
    universe is truth ∪ prediction (U6), or the explicit ``classes`` spine
    (column ``cls``) whose absent classes get zeros (A11)."""
    by = by or []
    sides = conf.select(*by, F.col("truth").alias("cls"),
                        F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("support"), F.lit(0).cast("long").alias("npred")) \
        .unionByName(conf.select(*by, F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"),
                                 F.lit(0).cast("long").alias("support"), F.col("n").alias("npred")))
    cc = sides.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                       F.sum("npred").alias("npred"))
    if classes is not None:
        spine = classes.select("cls") if not by else classes
        cc = spine.join(cc, [*by, "cls"], "left").na.fill(0, ["tp", "support", "npred"])
    return cc


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def per_class(cc: DataFrame) -> DataFrame:
    tp, sup, npred = F.col("tp"), F.col("support"), F.col("npred")
    return cc.select("*", _safe(tp, npred).alias("precision"), _safe(tp, sup).alias("recall"),
                     _safe(2 * tp, sup + npred).alias("f1"))


def report(df: DataFrame, y: str, p: str, classes: DataFrame | None = None) -> DataFrame:
    """A16 in long form ``(metric, cls, value)``: per-class precision,
    recall, f1, support; accuracy; macro, weighted and micro averages."""
    pc = per_class(class_counts(confusion(df, y, p), classes=classes))
    pc_long = pc.select("cls", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
          for m in ("precision", "recall", "f1", "support")])).alias("r")) \
        .select(F.col("r.metric").alias("metric"), F.col("cls").cast("string").alias("cls"),
                F.col("r.value").alias("value"))
    n = F.sum("support")
    tot = pc.agg(
        _safe(F.sum("tp"), n).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _safe(F.sum(F.col("precision") * F.col("support")), n).alias("weighted_precision"),
        _safe(F.sum(F.col("recall") * F.col("support")), n).alias("weighted_recall"),
        _safe(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        _safe(F.sum("tp"), F.sum("npred")).alias("micro_precision"),
        _safe(F.sum("tp"), n).alias("micro_recall"),
        _safe(2 * F.sum("tp"), n + F.sum("npred")).alias("micro_f1"),
    )
    names = [c for c in tot.columns]
    tot_long = tot.select(F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("r")) \
        .select(F.col("r.metric").alias("metric"), F.lit("all").alias("cls"), F.col("r.value").alias("value"))
    return pc_long.unionByName(tot_long).withColumn("value", F.round("value", 6))


def weighted_f1_from_counts(cc: DataFrame, by: list[str]) -> DataFrame:
    """A10 per group from class counts: sum(support * f1) / sum(support)."""
    f1 = _safe(2 * F.col("tp"), F.col("support") + F.col("npred"))
    return cc.groupBy(*by).agg(_safe(F.sum(F.col("support") * f1), F.sum("support")).alias("weighted_f1"),
                               _safe(F.sum("tp"), F.sum("support")).alias("accuracy"),
                               F.sum("support").alias("n"))


def weighted_accuracy(df: DataFrame, y: str, p: str, heavy: Column, weight: float) -> DataFrame:
    """Rows whose truth satisfies ``heavy`` weigh ``weight``."""
    w = F.when(heavy, F.lit(weight)).otherwise(F.lit(1.0))
    hit = (F.col(y) == F.col(p)).cast("double")
    return df.agg(F.round(F.sum(w * hit) / F.sum(w), 6).alias("weighted_accuracy"))


def category_accuracy(df: DataFrame, y: str, p: str, classes: DataFrame) -> DataFrame:
    """Per class of the spine, share of its rows predicted right; 0.0
    when the class never occurs as truth."""
    acc = df.groupBy(F.col(y).alias("cls")).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("a"))
    return classes.select("cls").join(acc, "cls", "left") \
        .select("cls", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("accuracy"))


def count_windows(steps: DataFrame, *, epoch: str, step: str, length: int,
                  window: str = "win_id") -> DataFrame:
    """Metrics are flushed when ``step % length == 0`` and buffers reset
    per epoch, so window ``ceil(step / length)`` within an epoch is logged
    only if it contains its flush step; unfinished tails are dropped.
    Adds the window id column and keeps only logged rows."""
    w = F.ceil(F.col(step) / F.lit(length)).cast("long")
    s = steps.withColumn(window, w).filter(F.col(epoch).isNotNull() & F.col(window).isNotNull())
    last = F.max(step).over(Window.partitionBy(epoch, window))
    return s.withColumn("_mx", last).filter(F.col("_mx") % length == 0).drop("_mx")


def window_confusion(steps: DataFrame, y: str, p: str, *, epoch: str, step: str, length: int,
                     window: str = "win_id") -> DataFrame:
    """``confusion`` of the rows that ``count_windows`` keeps, by epoch and window. The
    steps are reduced to counts before unfinished windows go, so a window is a
    few rows there, however often its steps repeat."""
    s = steps.withColumn(window, F.ceil(F.col(step) / F.lit(length)).cast("long"))
    cells = (s.groupBy(epoch, window, F.col(y).alias("truth"), F.col(p).alias("pred"))
             .agg(F.count("*").alias("n"), F.max(step).alias(step)))
    return count_windows(cells, epoch=epoch, step=step, length=length, window=window).drop(step)


def best_so_far(metrics: DataFrame, *, order: str, value: str) -> DataFrame:
    """A row is a new best when its value is strictly greater than every
    earlier one (start at -inf). Adds ``prev_best`` and ``is_new_best``.
    The frame is one row per epoch, small by construction."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max(value).over(w)
    return metrics.withColumn("prev_best", prev) \
        .withColumn("is_new_best", F.col("prev_best").isNull() | (F.col(value) > F.col("prev_best")))


def cross_entropy(logits: Column, label: Column) -> Column:
    """A21 per row: -log softmax(logits)[label] = logsumexp - logit[label]."""
    m = F.array_max(logits).cast("double")
    lse = m + F.log(F.aggregate(logits, F.lit(0.0).cast("double"),
                                lambda acc, x: acc + F.exp(x.cast("double") - m)))
    return lse - F.element_at(logits, label + 1).cast("double")

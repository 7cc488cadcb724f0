"""Windowed training metrics over a stream of steps (W5) and the best epoch so far.

State is kept per (epoch, window): the confusion counts of the steps seen and whether
the window's flush step was among them. Steps may come in any order and over any number of
micro-batches. A window with its flush step is written again whenever it
changes, under its micro-batch's number; the table's reader takes the last row of each window,
which is what the batch operator gives on the same steps. A micro-batch that is
repeated after a failure replaces its own folder.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.metrics import best_so_far
from ..session import ship_package

STEPS = "epoch long, step long, y int, p int"
STATE = "ys array<int>, ps array<int>, ns array<long>, flushed boolean"
WINDOWS = "epoch long, win_id long, n long, n_right long, accuracy double, weighted_f1 double"


def scores(counts: Counter) -> tuple[int, int, float, float]:
    """(rows, right rows, accuracy, F1 weighted by true support) of confusion counts."""
    n, right = sum(counts.values()), sum(k for (y, p), k in counts.items() if y == p)
    truth, given = Counter(), Counter()
    for (y, p), k in counts.items():
        truth[y] += k
        given[p] += k
    f1 = sum(s * 2 * counts[y, y] / (s + given[y]) for y, s in truth.items()) / n
    return n, right, round(right / n, 6), round(f1, 6)


def _update(length: int):
    def run(key, frames, state):
        counts, flushed = Counter(), False
        if state.exists:
            ys, ps, ns, flushed = state.get
            counts = Counter({(y, p): n for y, p, n in zip(ys, ps, ns)})
        for f in frames:
            flushed = flushed or bool((f["step"] % length == 0).any())
            for (y, p), n in f.groupby(["y", "p"]).size().items():
                counts[int(y), int(p)] += int(n)
        ys, ps = zip(*counts) if counts else ((), ())
        state.update((list(ys), list(ps), list(counts.values()), flushed))
        if flushed and counts:
            yield pd.DataFrame([(*key, *scores(counts))], columns=["epoch", "win_id", "n", "n_right", "accuracy", "weighted_f1"])
    return run


def start_step_metrics(spark: SparkSession, steps_dir: str, out_path: str, length: int, checkpoint: str) -> StreamingQuery:
    """Reads parquet files of steps ``(epoch, step, y, p)`` as they appear. ``checkpoint``: the
    stream's progress and state, from which a later session goes on. Rows with a null go out."""
    ship_package(spark)
    steps = spark.readStream.schema(STEPS).parquet(steps_dir).dropna()
    windows = (steps.withColumn("win_id", F.ceil(F.col("step") / F.lit(length)).cast("long")).groupBy("epoch", "win_id")
               .applyInPandasWithState(_update(length), WINDOWS, STATE, "update", GroupStateTimeout.NoTimeout))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={number}")

    return (windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def windows_of(spark: SparkSession, out_path: str) -> DataFrame:
    """The last state of each logged window."""
    rows = spark.read.schema(f"{WINDOWS}, batch long").parquet(out_path)
    last = F.max_by(F.struct("n", "n_right", "accuracy", "weighted_f1"), "batch").alias("w")
    return rows.groupBy("epoch", "win_id").agg(last).select("epoch", "win_id", "w.*")


def best_epochs(windows: DataFrame) -> DataFrame:
    """W6 on the logged windows: per epoch its accuracy and whether it beats all earlier ones."""
    per_epoch = windows.groupBy("epoch").agg(F.round(F.sum("n_right") / F.sum("n"), 6).alias("accuracy"))
    return best_so_far(per_epoch, order="epoch", value="accuracy")

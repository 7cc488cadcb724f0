"""Windows are judged on counts: one row a cell, not one a step."""

from pyspark.sql import functions as F

from verdict.operators.metrics import confusion, count_windows, window_confusion


def test_counts_of_windows_equal_counts_of_kept_steps(spark):
    rows = [(e, s, s % 3 if s % 7 else None, s % 2) for e in ("a", "b", None) for s in [*range(1, 47), 20, 20] if not (e == "b" and s == 30)]
    steps = spark.createDataFrame([*rows, ("a", None, 1, 1)], "epoch string, step long, y int, p int")
    got = window_confusion(steps, "y", "p", epoch="epoch", step="step", length=10)
    kept = count_windows(steps, epoch="epoch", step="step", length=10)
    want = confusion(kept, "y", "p", by=["epoch", "win_id"])
    key = lambda r: str(r)
    cols = ["epoch", "win_id", "truth", "pred", "n"]
    assert sorted(got.select(cols).collect(), key=key) == sorted(want.select(cols).collect(), key=key)
    windows = {(r.epoch, r.win_id) for r in kept.select("epoch", "win_id").distinct().collect()}
    assert windows == {("a", w) for w in range(1, 5)} | {("b", w) for w in (1, 2, 4)}
    assert kept.filter(F.col("epoch").isNull()).count() == 0


def test_steps_are_not_joined(spark):
    steps = spark.range(1, 1000).select(F.lit(1).alias("epoch"), F.col("id").alias("step"), F.lit(0).alias("y"), F.lit(1).alias("p"))
    plan = window_confusion(steps, "y", "p", epoch="epoch", step="step", length=10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan

"""Seeded batches, path models and streamed step metrics."""

import random

import numpy as np
from pyspark.sql import functions as F

from verdict.operators.batches import feistel, half_bits, round_keys, seeded_batches
from verdict.operators.metrics import class_counts, confusion, count_windows, weighted_f1_from_counts
from verdict.operators.path_models import fit_paths, in_training, predict_paths
from verdict.streaming.step_metrics import best_epochs, start_step_metrics, windows_of


def test_feistel_is_a_bijection(spark):
    for bits in (2, 4, 6):
        out = spark.range(4 ** bits).select("id", feistel(F.col("id"), bits, round_keys(1, 0, bits)).alias("k")).collect()
        assert sorted(r.k for r in out) == list(range(4 ** bits))
        assert sum(r.k == r.id for r in out) < 4 ** bits / 2
    assert half_bits(1) == 2 and 4 ** half_bits(10 ** 9) >= 10 ** 9


def test_batches_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7).alias("id"), F.lit("x").alias("batch_name"))

    def run(parts, epoch=0, seed=3):
        df = seeded_batches(rows.repartition(parts), "id", seed=seed, epoch=epoch, batch_size=64)
        return sorted((r.batch, r.place, r.id) for r in df.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    one = run(1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert run(17) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [b * 64 + p for b, p, _ in one] == list(range(1000))
    assert {i for _, _, i in one} == {7 * i for i in range(1000)}
    assert run(2, epoch=1) != one and run(2, seed=4) != one
    # the order is not near the order of ids
    places = np.array([i for _, _, i in one])
    assert abs(np.corrcoef(places, np.arange(1000))[0, 1]) < .15


def test_path_models_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = []
    for path in (0, 1):
        centre = rng.normal(size=(3, 3)) * 2
        for i in range(400):
            y = int(rng.integers(3))
            rows.append((i, path, y, [*(centre[y] + rng.normal(size=3)).tolist(), 1.0]))
    df = spark.createDataFrame(rows, "id long, path int, y int, x array<double>").repartition(5)
    train = df.filter(in_training("id"))
    weights = fit_paths(train, paths=2, classes=3, width=4, steps=30)
    for path in (0, 1):
        mine = [r for r in rows if r[1] == path and (r[0] * 7919 + 17) % 100 < 80]
        x, y = np.array([r[3] for r in mine]), np.array([r[2] for r in mine])
        bound = (np.abs(x) * np.abs(x).sum(1, keepdims=True)).sum(0) / 2 + 1
        w, last = np.zeros((3, 4)), -np.inf
        for _ in range(30):
            z = x @ w.T
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            value = np.log(p[np.arange(len(y)), y]).sum() - (w * w).sum() / 2
            assert value >= last - 1e-9         # no step lessens it
            last = value
            w = w + ((np.eye(3)[y] - p).T @ x - w) / bound
        assert np.allclose(weights[path], w, atol=1e-9)
    tested = predict_paths(df.filter(~in_training("id")), weights, 4)
    assert tested.filter("y = prediction").count() > .75 * tested.count()
    assert predict_paths(df.filter("false"), weights, 4).count() == 0


def test_streamed_metrics_equal_the_batch_after_a_restart(spark, scratch):
    rng = random.Random(5)
    steps = [(e, s, rng.randrange(3), rng.randrange(3)) for e in range(3) for s in range(250)]
    steps = [s for s in steps if s[:2] != (1, 77)] + [steps[5]]        # a step that is missing, one that comes twice
    rng.shuffle(steps)
    schema = "epoch long, step long, y int, p int"

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/steps")

    def go(session):
        start_step_metrics(session, f"{scratch}/steps", f"{scratch}/out", 100, f"{scratch}/progress").awaitTermination()
    more(steps[:300] + [(None, 1, 1, 1)])
    go(spark)
    more(steps[300:500])
    go(spark.newSession())
    more(steps[500:])
    go(spark.newSession())
    go(spark.newSession())          # nothing new
    batch = count_windows(spark.createDataFrame(steps, schema), epoch="epoch", step="step", length=100)
    cc = class_counts(confusion(batch, "y", "p", by=["epoch", "win_id"]), by=["epoch", "win_id"])
    want = weighted_f1_from_counts(cc, ["epoch", "win_id"]).select("epoch", "win_id", "n", F.round("accuracy", 6).alias("a"), F.round("weighted_f1", 6).alias("f"))
    got = windows_of(spark, f"{scratch}/out")
    assert sorted((r.epoch, r.win_id, r.n, r.accuracy, r.weighted_f1) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert got.count() == 9         # step 0, 1-100, 101-200 of each epoch; the tails are not logged
    best = {r.epoch: r for r in best_epochs(got).collect()}
    assert best[0].is_new_best and best[0].prev_best is None and len(best) == 3

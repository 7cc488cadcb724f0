"""Power-weighted probability ensemble (F8, J13) and its grid search.

Grid search plan: the grid (11^3 weights x 5^3 powers = 166,375 settings by
default) is a constant derived from the parameter lists, so its size is
known up front. Rows are spread over ``tasks`` tasks; each task
scores every setting for its rows with numpy and emits one dense array of counts
(class supports, predictions and true positives by setting and class) for each
combination of powers. These arrays are summed in a tree, ``fan`` at a time, so
what is shuffled is combinations x tasks rows and no setting is a row. Who sums a combination
scores its settings; those that may round to its best F1 go on, and a
``min_by`` picks the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENSEMBLE_POWERS, ENSEMBLE_WEIGHTS
from ..session import ship_package

SCORE_DECIMALS = 9
F1_DECIMALS = 5


SLICE_ROWS = 96   # rows scored at a time: a slice's scores of all weights stay in the cache


def blend(probs: list[Column], weights: tuple, powers: tuple, n_classes: int) -> Column:
    """F8: per class sum_i w_i * p_i[c] ** e_i, rounded to 9 places, then
    the first argmax (0-based)."""
    scores = []
    for c in range(n_classes):
        s = None
        for p, w, e in zip(probs, weights, powers):
            term = F.lit(float(w)) * F.pow(p[c], F.lit(float(e)))
            s = term if s is None else s + term
        scores.append(F.round(s, SCORE_DECIMALS))
    arr = F.array(*scores)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def _partial_counts(n_classes: int, weights, powers):
    """Per-task kernel. Loops over the power combinations (p1, p2, p3) and
    broadcasts all weight combinations at once: scores are
    ``(w1 * a + w2 * b) + w3 * c`` in that order (as in the SQL), rounded
    half away from zero to 9 places; scores are non-negative, so the rounded
    integer ``floor(x * 1e9 + 0.5)`` orders and ties exactly like the
    rounded value, and argmax takes the first maximum. Rows out: a combination and
    its counts, first the supports, then (wrong, right) by setting and predicted class."""
    w = np.asarray(weights, dtype=np.float64)[:, None]
    pw = np.asarray(powers, dtype=np.float64)
    nw, npw = len(w), len(pw)
    m = nw ** 3
    scale = 10.0 ** SCORE_DECIMALS

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((npw ** 3, m * n_classes * 2), dtype=np.int64)
        support = np.zeros(n_classes, dtype=np.int64)
        first_code = (np.arange(m, dtype=np.int64) * n_classes * 2)[:, None]
        for pdf in (whole.iloc[i:i + SLICE_ROWS] for whole in it for i in range(0, len(whole), SLICE_ROWS)):
            y = pdf["y"].to_numpy(np.int64)
            support += np.bincount(y, minlength=n_classes)[:n_classes]
            # weighted powers once per row: [model][power][class] -> (weights, rows)
            terms = [[[w * row for row in np.power(probs, e).T] for e in pw]
                     for probs in (np.stack(pdf[name].to_numpy()).astype(np.float64) for name in ("m1", "m2", "m3"))]
            shape = (nw, nw, nw, len(y))
            score, best = np.empty(shape), np.empty(shape)
            better, pred = np.empty(shape, dtype=bool), np.empty(shape, dtype=np.int64)
            for j1, j2 in product(range(npw), repeat=2):
                ab = [terms[0][j1][c][:, None] + terms[1][j2][c][None, :] for c in range(n_classes)]
                for j3 in range(npw):
                    for c in range(n_classes):
                        np.add(ab[c][:, :, None], terms[2][j3][c][None, None], out=score)
                        score *= scale
                        score += 0.5
                        np.floor(score, out=score)
                        if c == 0:
                            best, score = score, best
                            pred.fill(0)
                        else:
                            np.greater(score, best, out=better)                # first max wins
                            np.copyto(pred, c, where=better)
                            np.maximum(best, score, out=best)
                    code = pred.reshape(m, -1) * 2
                    code += pred.reshape(m, -1) == y
                    code += first_code
                    counts[(j1 * npw + j2) * npw + j3] += np.bincount(code.ravel(), minlength=m * n_classes * 2)
        if support.any():
            yield pd.DataFrame({"combination": np.arange(npw ** 3, dtype=np.int64),
                                "counts": [np.r_[support, c].tobytes() for c in counts]})
    return fn


def _summed(it: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    total: dict[int, np.ndarray] = {}
    for pdf in it:
        for k, raw in zip(pdf["combination"], pdf["counts"]):
            part = np.frombuffer(raw, dtype=np.int64)
            total[k] = total[k] + part if k in total else part
    yield from total.items()


def _sum_branches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for k, counts in _summed(it):
        yield pd.DataFrame({"combination": [k], "counts": [counts.tobytes()]})


def _best_settings(n_classes: int, n_combinations: int):
    """The settings of each combination that may round to its best F1: (setting id in
    loop order w1, w2, w3, p1, p2, p3; F1 before rounding)."""
    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, counts in _summed(it):
            support, by = counts[:n_classes], counts[n_classes:].reshape(-1, n_classes, 2)
            f1 = np.zeros(len(by))
            for c in range(n_classes):
                tp, both = by[:, c, 1], support[c] + by[:, c].sum(1)
                f1 += np.where(both > 0, support[c] * 2.0 * tp / np.maximum(both, 1), 0.0)
            f1 /= support.sum()
            near = np.flatnonzero(f1 >= f1.max() - 2 * 10.0 ** -F1_DECIMALS)
            yield pd.DataFrame({"sid": near * n_combinations + k, "f1": f1[near]})
    return fn


def grid_search(rows: DataFrame, *, n_classes: int = 5, weights=ENSEMBLE_WEIGHTS,
                powers=ENSEMBLE_POWERS, tasks: int | None = None, fan: int = 64) -> DataFrame:
    """A26. ``rows`` has ``y`` (true class code) and ``m1, m2, m3``
    (probability arrays). Returns one row: the best weighted F1 (rounded to
    5; strict improvement, so the first setting in loop order wins a tie;
    all zeros when no setting beats 0) and its setting."""
    spark = rows.sparkSession
    ship_package(spark)
    tasks = tasks or spark.sparkContext.defaultParallelism
    schema = "combination long, counts binary"
    parts = rows.select("y", "m1", "m2", "m3").repartition(tasks).mapInPandas(
        _partial_counts(n_classes, weights, powers), schema)
    while tasks > fan:
        tasks = -(-tasks // fan)
        parts = (parts.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(tasks))).repartition("combination", "branch")
                 .drop("branch").mapInPandas(_sum_branches, schema))
    scored = (parts.repartition("combination").mapInPandas(_best_settings(n_classes, len(powers) ** 3), "sid long, f1 double")
              .withColumn("f1", F.round("f1", F1_DECIMALS)))
    best = scored.agg(F.min_by(F.struct("sid", "f1"), F.struct(F.negative("f1"), F.col("sid"))).alias("b")) \
        .select("b.*")
    # setting id -> indices (loop order: w1, w2, w3 outer ... p3 inner)
    nw, npw = len(weights), len(powers)
    radix = [nw, nw, nw, npw, npw, npw]
    sid = F.col("sid")
    digits, div = [], 1
    for r in reversed(radix):
        digits.append(F.pmod(F.floor(sid / F.lit(div)), F.lit(r)).cast("int"))
        div *= r
    digits = digits[::-1]
    wl = F.array(*[F.lit(float(x)) for x in weights])
    pl = F.array(*[F.lit(float(x)) for x in powers])
    pick = [F.element_at(wl, digits[j] + 1) for j in range(3)] + \
           [F.element_at(pl, digits[j] + 1) for j in range(3, 6)]
    names = ["w1", "w2", "w3", "p1", "p2", "p3"]
    zero = F.col("f1") <= 0
    return best.select(F.when(zero, F.lit(0.0)).otherwise(F.col("f1")).alias("best_f1"),
                       *[F.when(zero, F.lit(0.0)).otherwise(c).alias(n) for c, n in zip(pick, names)],
                       F.when(zero, F.lit(-1)).otherwise(F.col("sid")).cast("long").alias("setting"))

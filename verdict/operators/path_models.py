"""One multinomial classifier a path (R10), fitted on a hash split by a fixed number of
majorised Newton steps.

Each step is one pass: tasks add up the gradient of their rows for all paths, the
sums are added by Spark, and the driver gets paths x classes x features numbers. The curvature is
bounded once, per feature, by ``sum |x_j| sum_k |x_k| / 2``: a step never lessens the
likelihood, needs no step size and no inverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package


def in_training(id_col: str, percent: int = 80) -> Column:
    """A split by the id alone."""
    return F.pmod(F.col(id_col) * 7919 + 17, F.lit(100)) < percent


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _long(name: str, values: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(p, c, j, float(x)) for p, m in values.items() for c, line in enumerate(m) for j, x in enumerate(line)]
    cols = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "cls", "j", name])


def _curvature(width: int):
    def run(batches):
        for b in batches:
            x, path = np.abs(_matrix(b.column("x"), width)), b.column("path").to_numpy()
            yield _long("v", {int(p): (x[path == p] * x[path == p].sum(1, keepdims=True)).sum(0)[None] / 2 for p in np.unique(path)})
    return run


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w.T
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _gradient(weights: dict[int, np.ndarray], width: int):
    def run(batches):
        for b in batches:
            x, path, y = _matrix(b.column("x"), width), b.column("path").to_numpy(), b.column("y").to_numpy()
            out = {}
            for p in np.unique(path):
                mine, w = path == p, weights[int(p)]
                miss = (np.arange(len(w)) == y[mine][:, None]) - _probabilities(x[mine], w)
                out[int(p)] = miss.T @ x[mine]
            yield _long("v", out)
    return run


def _predicted(weights: dict[int, np.ndarray], width: int):
    def run(batches):
        for b in batches:
            x, path = _matrix(b.column("x"), width), b.column("path").to_numpy()
            out = np.zeros(len(path), np.int32)
            for p in np.unique(path):
                out[path == p] = (x[path == p] @ weights[int(p)].T).argmax(1)
            yield b.append_column("prediction", pa.array(out))
    return run


def fit_paths(rows: DataFrame, *, paths: int, classes: int, width: int, steps: int = 10, reg: float = 1.0) -> dict[int, np.ndarray]:
    """Weights (classes x width) per path from rows ``(path, y, x)``, x with ``width`` components."""
    ship_package(rows.sparkSession)
    rows = cut_lineage(rows.select(F.col("path").cast("int").alias("path"), F.col("y").cast("int").alias("y"), "x"))

    def total(kernel) -> dict[int, np.ndarray]:
        out = {p: np.zeros((classes, width)) for p in range(paths)}
        sums = rows.mapInArrow(kernel, "path int, cls int, j int, v double").groupBy("path", "cls", "j").agg(F.sum("v").alias("v"))
        for r in sums.take(paths * classes * width):
            out[r.path][r.cls, r.j] = r.v
        return out

    bound = {p: m[0] + reg for p, m in total(_curvature(width)).items()}
    weights = {p: np.zeros((classes, width)) for p in range(paths)}
    for _ in range(steps):
        gradient = total(_gradient(weights, width))
        weights = {p: w + (gradient[p] - reg * w) / bound[p] for p, w in weights.items()}
    return weights


def predict_paths(rows: DataFrame, weights: dict[int, np.ndarray], width: int) -> DataFrame:
    """``rows`` with ``prediction``; ties go to the smaller class."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(_predicted(weights, width), T.StructType([*rows.schema.fields, T.StructField("prediction", T.IntegerType())]))


def weight_rows(spark, weights: dict[int, np.ndarray]) -> DataFrame:
    return spark.createDataFrame(
        [(p, c, j, float(x)) for p, m in weights.items() for c, line in enumerate(m) for j, x in enumerate(line)],
        "path int, cls int, j int, value double")

"""Mean pooling of vectors per key.

``posexplode`` -> ``groupBy(key, pos).avg``: a partial aggregate per
(key, position), so a key holding many vectors is combined map side and
never gathered in one task. The result stays in long form ``(key, pos,
mean)``; ``to_vector`` reassembles one array per key (bounded by the
dimension) when a wide vector is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, *, key: str, vec: str, decimals: int = 6) -> DataFrame:
    x = df.select(key, F.posexplode(vec).alias("pos", "v"))
    return x.groupBy(key, F.col("pos").cast("long").alias("pos")).agg(
        F.round(F.avg(F.col("v").cast("double")), decimals).alias("mean"))


def to_vector(long: DataFrame, *, key: str) -> DataFrame:
    s = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("_e"))
    return s.select(key, F.transform("_e", lambda e: e["mean"]).alias("vector"))

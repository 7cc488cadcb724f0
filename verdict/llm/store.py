"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of
    the warehouse, which executors share as well."""
    conf = spark.sparkContext.getConf()
    return (spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as a table of the shared folder and reads it again: cuts the
    lineage, survives lost executors, and later reads prune columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_anew(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join to an aggregate on its keys (or a part of them), hashed anew: both sides
    are then shuffled for the join, so Spark can split the rows of a hot key."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns],
                     F.xxhash64(*keys).alias("_r_hash"))
    same = F.xxhash64(*[left[c] for c in keys]) == r["_r_hash"]
    for c in keys:
        same = same & (left[c] == r[f"_r_{c}"])
    return left.join(r, same, how).drop("_r_hash", *[f"_r_{c}" for c in keys])


def release(spark: SparkSession) -> None:
    """Frees the plans, broadcasts and shuffle files of what a loop of the
    driver has finished; Spark does so when the driver's garbage is collected."""
    spark._jvm.System.gc()


class Scratch:
    """Intermediate tables of one operator, which go when its result is stored."""

    def __init__(self) -> None:
        self.kept: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, name: str = "stage") -> DataFrame:
        spark, path = df.sparkSession, new_path(df.sparkSession, name)
        self.kept.append((spark, path))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """df as a table of its own; the others are deleted."""
        out = stored(df, name)
        for spark, path in self.kept:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.kept.clear()
        return out

"""Result stores of whole runs (K2, U4, K6): a run's tables are written first, each
into a folder of its own, and count from the moment one numbered manifest names them.

* ``path/data/<table>/attempt=<id>``: rows of one attempt, parquet
* ``path/log/<number>.json``: one manifest a run: its name, its stamp and its attempt

A manifest's number is taken by creating its file, which the file system grants to one
writer only; who finds it taken tries the next. Of manifests of one run the lowest
counts, so a run that is appended again, or by several writers at once, is there once;
rows of an attempt without a manifest, and an unfinished manifest, are never read.
Manifests are read as a table and joined to the rows' attempt, a partition column, so
neither the log nor the rows pass through the driver and files of other attempts are
pruned at run time.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, attempt string, run_ts timestamp"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(run, attempt, run_ts, version) of the runs that count."""
    place, fs = _path(spark, f"{path}/log")
    if not fs.exists(place):
        return spark.createDataFrame([], f"{MANIFEST}, version long")
    log = spark.read.schema(MANIFEST).json(f"{path}/log").select(
        "*", F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)", 1).cast("long").alias("version"))
    first = F.min_by(F.struct("attempt", "run_ts", "version"), F.col("version")).alias("m")
    return log.filter("run is not null and attempt is not null").groupBy("run").agg(first).select("run", "m.*")


def _take_number(spark: SparkSession, path: str, number: int, body: str) -> bool:
    """Whether manifest ``number`` was free and now holds ``body``."""
    place, fs = _path(spark, f"{path}/log/{number:020d}.json")
    try:
        out = fs.create(place, False)
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    out.write(bytearray(body.encode()))
    out.close()
    return True


def append_run(path: str, run: str, tables: dict[str, DataFrame]) -> bool:
    """Appends the tables of one run; False, and nothing changes, if it is there already."""
    spark = next(iter(tables.values())).sparkSession
    there = manifests(spark, path).filter(F.col("run") == run)
    if not there.isEmpty():
        return False
    attempt = "a" + uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/data/{name}/attempt={attempt}")
    body = json.dumps({"run": run, "attempt": attempt, "run_ts": datetime.now(timezone.utc).isoformat()})
    number = (manifests(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    while True:
        if _take_number(spark, path, number, body):
            now = manifests(spark, path).filter(F.col("run") == run).select("attempt").take(1)
            if now and now[0].attempt == attempt:
                return True
            if now:
                break
        number += 1   # taken, or (on file systems that grant a file twice) written over
    for name in tables:   # another writer's attempt of this run has a lower number
        place, fs = _path(spark, f"{path}/data/{name}/attempt={attempt}")
        fs.delete(place, True)
    return False


def read_runs(spark: SparkSession, path: str, table: str, schema: str, until: int | None = None) -> DataFrame:
    """Rows of ``table`` of all runs that count (to version ``until``), with run, run_ts and version."""
    runs = manifests(spark, path)
    if until is not None:
        runs = runs.filter(F.col("version") <= until)
    place, fs = _path(spark, f"{path}/data/{table}")
    rows = (spark.read.schema(f"{schema}, attempt string").parquet(f"{path}/data/{table}") if fs.exists(place)
            else spark.createDataFrame([], f"{schema}, attempt string"))
    return rows.join(runs, "attempt").drop("attempt")

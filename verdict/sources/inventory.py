"""Image folders as a kept inventory.

``list_files`` walks a folder tree level by level: the folders of a level are a
distributed table, each task lists its own, and what they hold is the next level. The
driver asks only whether a next level exists. A folder by itself is listed by one task.

``take_inventory`` keeps a listing as a run of a result store (``runlog``), and
``changes`` compares two of them, so a job reads only the files that came or changed
since its last run.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .runlog import append_run, read_runs

FILES = "path string, size long, modified timestamp"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp")


def _with_scheme(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _opened(folder: str):
    """(file system, path in it, what stands before that path) of a folder."""
    from pyarrow import fs

    if folder.startswith("/") or folder.startswith("file://"):
        head = folder[:7] if folder.startswith("file://") else ""
        return fs.LocalFileSystem(), folder[len(head):], head
    system, inner = fs.FileSystem.from_uri(quote(folder, safe=":/@"))
    return system, inner, folder[:folder.rindex(inner)]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for b in batches:
        for folder in b.column("path").to_pylist():
            system, inner, head = _opened(folder)
            found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            yield pa.RecordBatch.from_arrays([
                pa.array([head + f.path for f in found], pa.string()),
                pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                pa.array([f.size for f in found], pa.int64()),
                pa.array([f.mtime for f in found], pa.timestamp("us", "UTC"))], ["path", "is_folder", "size", "modified"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of all files under ``root``; names that begin with a dot or an
    underscore are left out, as Spark's own readers do. A missing folder has no files."""
    ship_package(spark)
    folders = spark.createDataFrame([(_with_scheme(root.rstrip("/")),)], "path string")
    out = spark.createDataFrame([], FILES)
    name = F.element_at(F.split("path", "/"), -1)
    while True:
        level = cut_lineage(folders.repartition("path").mapInArrow(
            _entries, f"path string, is_folder boolean, {FILES.split(', ', 1)[1]}").filter(~name.rlike("^[._]")))
        out = out.unionByName(level.filter("not is_folder").drop("is_folder"))
        folders = level.filter("is_folder").select("path")
        if folders.isEmpty():
            return out


def file_name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def images(files: DataFrame, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """The files with an image's suffix in any case, with ``name``, the join key of J15."""
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes)).withColumn("name", file_name())


def take_inventory(spark: SparkSession, root: str, store: str, run: str) -> bool:
    """Keeps the listing of ``root`` as ``run``; False if that run is there already."""
    return append_run(store, run, {"files": list_files(spark, root)})


def inventory(spark: SparkSession, store: str, run: str) -> DataFrame:
    return read_runs(spark, store, "files", FILES).filter(F.col("run") == run).select("path", "size", "modified")


def changes(spark: SparkSession, store: str, before: str, after: str) -> DataFrame:
    """(path, change): what was ``added``, ``removed`` or ``changed`` (size or time) between two inventories."""
    old = inventory(spark, store, before).select("path", F.struct("size", "modified").alias("old"))
    new = inventory(spark, store, after).select("path", F.struct("size", "modified").alias("new"))
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
              .when(~F.col("old").eqNullSafe(F.col("new")), "changed"))
    return old.join(new, "path", "full").select("path", change.alias("change")).filter("change is not null")

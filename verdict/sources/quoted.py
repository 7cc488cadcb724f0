"""Delimited text with quoted newlines, read by many tasks a file.

Spark's ``multiLine`` gives a whole file to one task. Here a file is read in splits,
line by line:

1. Count the quotes of each split. A line break ends a record if an even number
   of quotes stands before it in the file; a prefix sum over the splits (one row a split)
   tells each split whether it begins inside a quoted field.
2. Each split joins its own lines to records as it streams over them. Only what crosses
   a border of splits (at most a head and a tail a split) is shuffled, and joined in
   the order of the splits.
3. Records become columns by Spark's ``from_csv``.

A quote that is no part of a quoted field must not occur (as RFC 4180 has it); a file with an
odd number of quotes fails. Lines end at ``\\n`` or ``\\r\\n``; blank lines outside of quotes are
skipped. Compressed files are read as one split. A record is held whole by one task, a file never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

_PARTS = "file string, split long, place string, nth long, record string"
WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"


def _records(quote: str):
    """(file, split, place, nth, record) of the lines of a partition, in order.
    A head ends a record of an earlier split, a tail begins one of a later split, a
    middle is a split without any border of records."""
    def run(batches):
        key, inside, began, nth, held = None, False, False, 0, []

        def end():
            # what the split leaves open
            if key is not None and held:
                yield (*key, TAIL if began else MIDDLE, nth, "\n".join(held))

        def out(rows):
            cols = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                ["file", "split", "place", "nth", "record"])

        for b in batches:
            rows = []
            odd = pc.count_substring(b.column("value"), quote).to_numpy(zero_copy_only=False) % 2 == 1
            files, splits, first = b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("inside").to_pylist()
            for i, line in enumerate(b.column("value").to_pylist()):
                if (files[i], splits[i]) != key:
                    rows += end()
                    key, inside, nth, held = (files[i], splits[i]), first[i], 0, []
                    began = not inside      # the first line begins a record, or goes on with one
                held.append(line)
                inside ^= bool(odd[i])
                if not inside:
                    rows.append((*key, WHOLE if began else HEAD, nth, "\n".join(held)))
                    nth, held, began = nth + 1, [], True
            yield out(rows)
        yield out(list(end()))
    return run


def _with_start(lines: DataFrame, starts: DataFrame, max_broadcast: int) -> DataFrame:
    """Each line with whether its split begins inside a quoted field, the lines of a split in their order."""
    if starts.count() <= max_broadcast:
        return lines.join(F.broadcast(starts), ["file", "split"])     # lines stay where they are
    numbered = lines.withColumn("_row", F.monotonically_increasing_id())
    return (numbered.join(starts, ["file", "split"]).repartition("file", "split")
            .sortWithinPartitions("file", "split", "_row").drop("_row"))


def quoted_records(spark: SparkSession, path: str | list[str], quote: str = '"', max_broadcast: int = 200_000) -> DataFrame:
    """(file, first, last, record): the records of the files; ``last``, the split and the number
    therein where a record ends, is their order in a file, and ``first`` where it begins.

    ``max_broadcast``: splits whose starts are broadcast (some 100 bytes each); beyond
    that the lines are shuffled by split."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    splits = cut_lineage(lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd")))
    odd = splits.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1").select("file").take(1)
    if odd:
        raise ValueError(f"odd number of quotes in {odd[0].file}")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    ship_package(spark)
    parts = _with_start(lines, starts, max_broadcast).select("value", "file", "split", "inside") \
        .mapInArrow(_records(quote), _PARTS).withColumn("at", F.struct("split", "nth"))
    # a tail and what follows up to the next head make one record; at most two such pieces a split
    order = Window.partitionBy("file").orderBy("at")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("at", "record"))), lambda x: x["record"])
    joined = (parts.filter(f"place <> '{WHOLE}'")
              .withColumn("group", F.sum(F.when(F.col("place") == TAIL, 1).otherwise(0)).over(order))
              .groupBy("file", "group").agg(F.min("at").alias("first"), F.max("at").alias("last"),
                                            F.array_join(pieces, "\n").alias("record")).drop("group"))
    whole = parts.filter(f"place = '{WHOLE}'").select("file", F.col("at").alias("first"), F.col("at").alias("last"), "record")
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted(spark: SparkSession, path: str | list[str], schema: T.StructType, *, sep: str = ",", quote: str = '"',
                header: bool = True, mode: str = "PERMISSIVE", position: str | None = None,
                max_broadcast: int = 200_000) -> DataFrame:
    """Delimited text with quoted fields that may hold separators, doubled quotes and
    newlines. ``header``: the first record of each file is skipped. ``position``: name
    of a column with the record's place (file, split, number), which orders rows as the files do."""
    rows = quoted_records(spark, path, quote, max_broadcast).filter("record <> ''")
    if header:
        rows = rows.filter("not (first.split = 0 and first.nth = 0)")
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": mode}
    out = rows.select(F.from_csv("record", schema.toDDL(), options).alias("_r"),
                      F.struct("file", F.col("last.split"), F.col("last.nth")).alias("_at"))
    return out.select("_r.*", *([F.col("_at").alias(position)] if position else []))

"""Sets of ids as compressed bitmaps, one row a container.

A set is rows ``(key..., bucket, n, ids)``: ``bucket`` names a range of 2^15 ids and
``ids`` holds those that are in the set, as sorted 16-bit positions up to 2,047 of
them, else as a bitmap of 4,096 bytes. Sets are built and merged by Spark's bitmap
aggregates, which combine map side and take an id once however often it is
given; a hot key is spread over its containers, and no list of its ids is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITMAP_BYTES = 4096     # fixed by Spark's bitmap functions
TESTED_ROWS = 256


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def positions(container: bytes) -> np.ndarray:
    """The sorted positions that a container holds."""
    if len(container) == BITMAP_BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype("<u2")
    return np.frombuffer(container, "<u2")


def container(at: np.ndarray) -> bytes:
    """The shorter form of sorted positions."""
    if 2 * len(at) < BITMAP_BYTES:
        return at.astype("<u2").tobytes()
    bits = np.zeros(8 * BITMAP_BYTES, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _replaced(batch: pa.RecordBatch, values: list[bytes]) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(values, pa.binary()))


def _compressed(batches):
    for b in batches:
        yield _replaced(b, [container(positions(v)) for v in b.column("ids").to_pylist()])


def _expanded(batches):
    for b in batches:
        out = []
        for v in b.column("ids").to_pylist():
            bits = np.zeros(8 * BITMAP_BYTES, np.uint8)
            bits[positions(v)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield _replaced(b, out)


def _stored_form(sets: DataFrame) -> DataFrame:
    sets = sets.withColumn("n", F.bitmap_count("ids"))
    return sets.mapInArrow(_compressed, sets.schema)


def id_sets(members: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The set of non-null ids of each key."""
    return _stored_form(
        members.filter(F.col(id_col).isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(id_col).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("ids")))


def merge_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the union of both sets; later judgements join an earlier table so."""
    both = a.select(*keys, "bucket", "ids").unionByName(b.select(*keys, "bucket", "ids"))
    return _stored_form(both.mapInArrow(_expanded, both.schema)
                        .groupBy(*keys, "bucket").agg(F.bitmap_or_agg("ids").alias("ids")))


def set_sizes(sets: DataFrame, keys: list[str], name: str = "n_ids") -> DataFrame:
    return sets.groupBy(*keys).agg(F.sum("n").alias(name))


def _common(batches):
    for b in batches:
        out = [np.intersect1d(positions(x), positions(y), assume_unique=True)
               for x, y in zip(b.column("ids").to_pylist(), b.column("_other").to_pylist())]
        b = b.drop_columns(["_other"])
        b = b.set_column(b.schema.get_field_index("n"), "n", pa.array([len(x) for x in out], pa.int64()))
        yield _replaced(b, [container(x) for x in out])


def intersect_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key what both sets hold; containers without a common id go."""
    a = a.select(*keys, "bucket", "n", "ids")
    both = a.join(b.select(*keys, "bucket", F.col("ids").alias("_other")), [*keys, "bucket"])
    return both.mapInArrow(_common, a.schema).filter("n > 0")


def _tested(name: str):
    def run(batches):
        # a row brings a container of up to 2,047 positions: few rows at a time
        for b in (b.slice(i, TESTED_ROWS) for b in batches for i in range(0, b.num_rows, TESTED_ROWS)):
            ids, at = b.column("_ids"), b.column("_at").to_numpy(zero_copy_only=False)
            there = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            found = np.zeros(b.num_rows, bool)
            if len(there):
                raw, off = _offsets(ids.take(pa.array(there)))
                size, place = np.diff(off), at[there].astype(np.int64)
                wide = size == BITMAP_BYTES
                found[there[wide]] = raw[off[:-1][wide] + place[wide] // 8] >> (place[wide] % 8).astype(np.uint8) & 1
                narrow = np.flatnonzero(~wide)
                half = size[narrow] // 2
                # every position of the short containers beside the one that is asked for
                row = np.repeat(narrow, half)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(half) - half, half)
                first = off[row] + 2 * nth
                value = raw[first] + (raw[first + 1].astype(np.int64) << 8)
                found[there[row[value == place[row]]]] = True
            yield b.drop_columns(["_ids", "_at"]).append_column(name, pa.array(found))
    return run


def in_sets(rows: DataFrame, sets: DataFrame, keys: list[str], id_col: str, name: str) -> DataFrame:
    """``rows`` with a column that tells whether the row's id is in the set of
    its key; false for a null id or a key without a set. ``bucket`` must not be a column
    of ``rows``."""
    asked = rows.withColumn("bucket", F.bitmap_bucket_number(id_col)).withColumn("_at", F.bitmap_bit_position(id_col))
    met = asked.join(sets.select(*keys, "bucket", F.col("ids").alias("_ids")), [*keys, "bucket"], "left")
    met = met.select(*rows.columns, F.coalesce("_at", F.lit(0)).alias("_at"), "_ids")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])
    return met.mapInArrow(_tested(name), schema)

"""Seeded shuffle into batches (T7 with S6), the same on any cluster.

Rows are numbered densely by id, a keyed Feistel network maps each number to
another one of its domain, and the rank of that number is the row's place. The network is a
bijection, so no two rows share a place; it depends on seed, epoch and number
only, not on partitions, and the two sorts are range partitioned.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prep import dense_index

ROUNDS = 6
MULTIPLIER = 40_503     # products stay within 64 bits up to 22 bits a half


def round_keys(seed: int, epoch: int, bits: int) -> list[int]:
    """One key a round, below 2^bits."""
    return [int.from_bytes(hashlib.blake2b(f"{seed}/{epoch}/{r}".encode(), digest_size=8).digest(), "big") % (1 << bits)
            for r in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of each half of a domain of at least n numbers."""
    bits = max(2, (max(n - 1, 1).bit_length() + 1) // 2)
    if bits > 22:
        raise ValueError("more than 2^44 rows")
    return bits


def feistel(index: Column, bits: int, keys: list[int]) -> Column:
    """A bijection of [0, 4^bits)."""
    size = F.lit(1 << bits).cast("long")
    left, right = F.floor(index / size).cast("long"), index % size
    for key in keys:
        x = right + F.lit(key).cast("long")
        mixed = (x * x * MULTIPLIER + F.floor(x / 3).cast("long") + key) % size
        left, right = right, left.bitwiseXOR(mixed)
    return left * size + right


def sql_feistel(index: str, bits: int, keys: list[int], source: str) -> str:
    """CTEs r0 .. r{ROUNDS} over ``source`` with the same network; the last has ``key``."""
    size = 1 << bits
    out = [f"r0 AS (SELECT *, {index} // {size} AS l, {index} % {size} AS r FROM {source})"]
    for i, key in enumerate(keys):
        mixed = f"((r + {key}) * (r + {key}) * {MULTIPLIER} + (r + {key}) // 3 + {key}) % {size}"
        out.append(f"r{i + 1} AS (SELECT * REPLACE (r AS l, xor(l, {mixed}) AS r) FROM r{i})")
    return ",\n".join(out)


def seeded_batches(rows: DataFrame, id_col: str, *, seed: int, epoch: int, batch_size: int, n: int | None = None) -> DataFrame:
    """``rows`` with ``epoch``, ``batch`` and ``place`` (in the batch); ids must be unique.
    Another epoch gives another order. ``n``: number of rows, if known."""
    bits = half_bits(rows.count() if n is None else n)
    numbered = dense_index(rows, id_col, "_idx")
    keyed = numbered.withColumn("_key", feistel(F.col("_idx"), bits, round_keys(seed, epoch, bits))).drop("_idx")
    placed = dense_index(keyed, "_key", "_nth").drop("_key")
    return placed.withColumns({"epoch": F.lit(epoch), "batch": F.floor(F.col("_nth") / batch_size).cast("long"),
                               "place": (F.col("_nth") % batch_size).cast("long")}).drop("_nth")

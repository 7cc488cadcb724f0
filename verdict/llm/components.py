"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, stored


def _least(edges: DataFrame) -> DataFrame:
    """Per u the least neighbour; the key is hashed anew so that the join to it
    shuffles both sides and Spark can split a node of very many edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.xxhash64("u").alias("k"), F.col("u").alias("w"), "m")


def _with_least(edges: DataFrame) -> DataFrame:
    m = _least(edges)
    return edges.join(m, (F.xxhash64(edges.u) == m.k) & (edges.u == m.w)).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60, stored=stored) -> DataFrame:
    """(node, component) for every node of the edges (two long columns, any
    order, repeats allowed); component is the least node reachable. Nodes
    without edges are not in the result. ``stored`` writes a table and reads it."""
    a, b = edges.columns
    cur = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_least(both).filter("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        rows = _with_least(large)
        small = (rows.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").filter("u <> v").distinct())
        cur = stored(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if now == before:
            break
        before = now
        release(cur.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())

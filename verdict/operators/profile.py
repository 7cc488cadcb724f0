"""Corpus profiling: value counts (A1), availability by group (A2, F12),
describe-style statistics (A3, A5), coverage (A4), fetch statistics with an
overall rollup row (A20) and the long-form profile report (R9, P3).

Everything is a partial aggregate. Percentiles are exact and interpolated
(pandas ``describe`` / SQL ``quantile_cont``); Spark's ``percentile`` keeps a
value->count map per group, so its state is bounded by the number of
distinct values (text lengths), not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIBE = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """A1 for several columns in one pass: ``(field, value, n)``; nulls are
    not counted (pandas ``value_counts``)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                      for f in fields])
    return (df.select(F.explode(pairs).alias("r")).select("r.*").filter(F.col("value").isNotNull())
            .groupBy("field", "value").agg(F.count("*").alias("n")))


def pct(num: Column, den: Column) -> Column:
    """percentage of total; null when the total is 0."""
    return F.round(F.lit(100.0) * num / F.nullif(den, F.lit(0)), 6)


def availability(df: DataFrame, group: str, id_col: str, flags: dict[str, Column]) -> DataFrame:
    """A2: per group the row count, non-null count of each flag column and
    its percentage."""
    aggs = [F.count(id_col).alias("total")]
    for name, c in flags.items():
        aggs.append(F.count(c).alias(name))
    g = df.groupBy(group).agg(*aggs)
    return g.select("*", *[pct(F.col(n), F.col("total")).alias(f"{n}_pct") for n in flags])


def describe(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """A3: count, mean, sample std, min, 25/50/75 % (interpolated), max."""
    by = by or []
    v = value.cast("double")
    g = df.select(*by, v.alias("_v")).groupBy(*by).agg(
        F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"), F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.max("_v").alias("max"))
    return g.select(*by, "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    F.round("min", 6).alias("min"), F.round(F.col("_q")[0], 6).alias("p25"),
                    F.round(F.col("_q")[1], 6).alias("p50"), F.round(F.col("_q")[2], 6).alias("p75"),
                    F.round("max", 6).alias("max"))


def coverage(df: DataFrame, id_col: str, a: Column, b: Column) -> DataFrame:
    """A4: rows, non-null counts of two columns, both present and its share."""
    both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    return df.agg(F.count(id_col).alias("rows"), F.count(a).alias("with_a"), F.count(b).alias("with_b"),
                  both.alias("both"), pct(both, F.count(id_col)).alias("both_pct"))


def fetch_stats(status: DataFrame, *, category: str = "category", role: str = "role",
                ok: str = "ok") -> DataFrame:
    """Per category and overall (``ALL``, via rollup) totals and
    successes for claim and evidence images; totals count every row."""
    r, o = F.col(role), F.col(ok)
    g = status.rollup(category).agg(
        F.count(F.when(r == "claim", 1)).alias("total_claim"),
        F.count(F.when((r == "claim") & o, 1)).alias("successful_claim"),
        F.count(F.when(r == "evidence", 1)).alias("total_evidence"),
        F.count(F.when((r == "evidence") & o, 1)).alias("successful_evidence"),
        F.count(F.when(o, 1)).alias("successful"),
        F.grouping(category).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(category)).alias(category),
                    "total_claim", "successful_claim", "total_evidence", "successful_evidence", "successful")


def to_long(df: DataFrame, section: str, key: Column, stats: list[str]) -> DataFrame:
    """Wide statistics -> ``(section, key, stat, value double)``."""
    arr = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats])
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                     F.explode(arr).alias("r")).select("section", "key", "r.stat", "r.value")

"""Verdict aggregation: majority vote (A6), sufficiency vote (A7), claim
verdict from evidence verdicts (A8, U2) and the two-level NEI gate (R7, U3).

Votes are two partial aggregates: (claim, label) counts and max score, then
the winner per claim chosen with ``min_by`` over an ordering struct, so no
claim's answers are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NEI, REFUTE, SUPPORT


def majority_vote(answers: DataFrame, *, claim: str, label: str, score: str,
                  out: str = "final_label", claims: DataFrame | None = None,
                  nei_label: str = "NEI") -> DataFrame:
    """The most frequent label; ties by the highest single score, then
    by label ascending. Output ``claim, out, votes, max_score``. ``claims``: a table
    with the claim column; its claims without answers get ``nei_label``, no votes
    and a null score."""
    g = answers.groupBy(claim, label).agg(F.count("*").alias("votes"), F.max(score).alias("max_score"))
    key = F.struct(F.negative("votes"), F.negative("max_score"), F.col(label))
    best = F.min_by(F.struct(F.col(label).alias(out), "votes", "max_score"), key)
    won = g.groupBy(claim).agg(best.alias("b")).select(claim, "b.*")
    if claims is None:
        return won
    return (claims.select(claim).distinct().join(won, claim, "left")
            .select(claim, F.coalesce(out, F.lit(nei_label)).alias(out),
                    F.coalesce("votes", F.lit(0)).alias("votes"), "max_score"))


def claim_verdict(evidence: DataFrame, *, claim: str, position: str, verdict: str,
                  claims: DataFrame | None = None) -> DataFrame:
    """Support vs refute counts over a claim's evidence (text evidence
    first, 1-based ``position``); none or equal -> not_enough_information,
    else the larger. ``contributing`` lists the positions whose verdict
    equals the final one (bounded by the evidence per claim). ``claims``: a table
    with the claim column; its claims without evidence get
    not_enough_information, zero counts and no positions."""
    v = F.col(verdict)
    g = evidence.groupBy(claim).agg(
        F.count(F.when(v == SUPPORT, 1)).alias("n_support"),
        F.count(F.when(v == REFUTE, 1)).alias("n_refute"),
        F.count(F.when(v == NEI, 1)).alias("n_nei"),
        F.collect_list(F.struct(F.col(position).alias("pos"), v.alias("v"))).alias("_ev"))
    s, r = F.col("n_support"), F.col("n_refute")
    final = F.when((s == 0) & (r == 0), NEI).when(s == r, NEI).when(s > r, SUPPORT).otherwise(REFUTE)
    g = g.withColumn("verdict", final)
    contrib = F.array_sort(F.transform(F.filter("_ev", lambda e: e["v"] == F.col("verdict")),
                                       lambda e: e["pos"]))
    counts = ["n_support", "n_refute", "n_nei"]
    out = g.select(claim, "verdict", *counts,
                   F.concat_ws(",", F.transform(contrib, lambda x: x.cast("string"))).alias("contributing"))
    if claims is None:
        return out
    return (claims.select(claim).distinct().join(out, claim, "left")
            .select(claim, F.coalesce("verdict", F.lit(NEI)).alias("verdict"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                    F.coalesce("contributing", F.lit("")).alias("contributing")))


def two_level_verdict(level1: DataFrame, level2: DataFrame, *, claim: str, label: str,
                      score: str, nei_label: str = "NEI",
                      claims: DataFrame | None = None) -> DataFrame:
    """A7 vote over level-1 answers; claims voted ``NEI`` are final
    there; the rest take the A6 vote over their level-2 answers (U3 union of
    the disjoint halves). Claims that go on without a level-2 answer, and those of
    ``claims`` without a level-1 answer, get ``NEI`` at that level."""
    v1 = majority_vote(level1, claim=claim, label=label, score=score, claims=claims, nei_label=nei_label)
    nei = v1.filter(F.col("final_label") == nei_label).select(claim, "final_label", F.lit(1).alias("level"))
    go_on = v1.filter(F.col("final_label") != nei_label).select(claim)
    l2 = level2.join(go_on, claim, "left_semi")
    v2 = majority_vote(l2, claim=claim, label=label, score=score, claims=go_on, nei_label=nei_label) \
        .select(claim, "final_label", F.lit(2).alias("level"))
    return nei.unionByName(v2)


def binary_claims(claims: DataFrame, *, label: str = "v_label", nei_label: str = "NEI") -> DataFrame:
    """Binary verification keeps only claims whose gold label is not
    NEI (a null label is kept out as well)."""
    return claims.filter(F.col(label).isNotNull() & (F.col(label) != nei_label))

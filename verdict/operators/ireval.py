"""Retrieval evaluation: Hit@k (A18), P@k / R@k / MAP@k (A17, W4, T4),
relevance summaries (S7, A24) and the off-format answer rate (A19).

All metrics are computed from ranked rows with windows bounded by k and
partial aggregates; a query without candidates scores 0 and stays in the mean.
Relevant sets are summarised (size, min, max) with aggregates, never
collected into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RETRIEVAL_KS
from .idsets import id_sets, in_sets, set_sizes


def _ks_long(per_k: DataFrame, ks: list[int], cols: list[str]) -> DataFrame:
    """Wide ``{col}_{k}`` columns of a one-row frame -> rows ``(k, col...)``."""
    structs = [F.struct(F.lit(k).cast("int").alias("k"),
                        *[F.col(f"{c}_{k}").alias(c) for c in cols]) for k in ks]
    return per_k.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def hit_at_k(ranked: DataFrame, queries: DataFrame, *, q_id: str = "query_id",
             rank: str = "rank", is_gold: str = "is_gold",
             ks: list[int] = RETRIEVAL_KS) -> DataFrame:
    """Share of queries whose gold row is within the first k; the
    denominator is every query in ``queries`` (A18)."""
    gold = (ranked.filter(F.col(is_gold))
            .groupBy(q_id).agg(F.min(rank).alias("_gr")))
    per_q = queries.select(q_id).join(gold, q_id, "left")
    aggs = [F.round(F.avg(F.when(F.col("_gr") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_rate_{k}")
            for k in ks]
    return _ks_long(per_q.agg(*aggs), ks, ["hit_rate"])


def prf_map_at_k(ranked: DataFrame, n_gold: DataFrame, *, q_id: str = "query_id",
                 rank: str = "rank", is_rel: str = "is_rel", gold_count: str = "n_gold",
                 ks: list[int] = RETRIEVAL_KS) -> DataFrame:
    """P@k = hits / returned, R@k = hits / |gold|,
    AP@k = sum(hits so far / rank at each hit) / min(k, |gold|);
    means over every query of ``n_gold`` (A17)."""
    w = Window.partitionBy(q_id).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    r = (ranked.withColumn("_rel", F.col(is_rel).cast("int"))
         .withColumn("_so_far", F.sum("_rel").over(w)))
    aggs = []
    for k in ks:
        inside = F.col(rank) <= k
        aggs += [F.count(F.when(inside, 1)).alias(f"n_{k}"),
                 F.sum(F.when(inside, F.col("_rel")).otherwise(0)).alias(f"h_{k}"),
                 F.sum(F.when(inside & (F.col("_rel") == 1), F.col("_so_far") / F.col(rank))
                       .otherwise(0.0)).alias(f"s_{k}")]
    per_q = n_gold.select(q_id, gold_count).join(r.groupBy(q_id).agg(*aggs), q_id, "left")
    g = F.col(gold_count)
    outs = []
    for k in ks:
        n, h, s = F.coalesce(F.col(f"n_{k}"), F.lit(0)), F.coalesce(F.col(f"h_{k}"), F.lit(0)), \
            F.coalesce(F.col(f"s_{k}"), F.lit(0.0))
        outs += [F.round(F.avg(F.when(n > 0, h / n).otherwise(0.0)), 6).alias(f"precision_{k}"),
                 F.round(F.avg(F.when(g > 0, h / g).otherwise(0.0)), 6).alias(f"recall_{k}"),
                 F.round(F.avg(F.when(g > 0, s / F.least(F.lit(k), g)).otherwise(0.0)), 6)
                 .alias(f"map_{k}")]
    return _ks_long(per_q.agg(*outs), ks, ["precision", "recall", "map"])


def same_label_relevance(items: DataFrame, *, id_col: str, label_col: str,
                         out_id: str = "query_id") -> DataFrame:
    """Relevance = equal label, excluding the item itself. Returns per item
    ``n_relevant``, ``min_relevant`` (the gold), ``max_relevant`` from
    per-label aggregates (two smallest / two largest ids), so no pair of a
    label group is ever materialised."""
    summ = items.groupBy(label_col).agg(
        F.count("*").alias("_n"),
        F.min(id_col).alias("_min1"), F.max(id_col).alias("_max1"))
    # second smallest / largest via a filtered re-aggregate (still per label)
    sec = (items.join(summ.select(label_col, "_min1", "_max1"), label_col)
           .groupBy(label_col).agg(
               F.min(F.when(F.col(id_col) != F.col("_min1"), F.col(id_col))).alias("_min2"),
               F.max(F.when(F.col(id_col) != F.col("_max1"), F.col(id_col))).alias("_max2")))
    s = summ.join(sec, label_col)
    i = F.col(id_col)
    return (items.select(id_col, label_col).join(s, label_col)
            .select(i.alias(out_id),
                    (F.col("_n") - 1).alias("n_relevant"),
                    F.when(i == F.col("_min1"), F.col("_min2")).otherwise(F.col("_min1")).alias("min_relevant"),
                    F.when(i == F.col("_max1"), F.col("_max2")).otherwise(F.col("_max1")).alias("max_relevant")))


def relevant_sets(judged: DataFrame) -> DataFrame:
    """Per query the set of its positive documents, from judgements
    ``(query_id, doc_id, positive)``, as bitmap containers."""
    return id_sets(judged.filter("positive"), ["query_id"], "doc_id")


def judged_metrics(ranked: DataFrame, queries: DataFrame, sets: DataFrame, *, ks: list[int] = RETRIEVAL_KS) -> DataFrame:
    """A17 against judgements: ``ranked`` has ``query_id, corpus_id, rank`` and
    ``queries`` has ``query_id, claim_id``, the claim whose relevant set judges the
    query's list. The query's own document does not count as relevant to it. Hits are
    told by membership; a set is never listed."""
    by_claim = sets.withColumnRenamed("query_id", "claim_id")
    sizes = set_sizes(by_claim, ["claim_id"], "n_set")
    own = in_sets(queries.select("query_id", "claim_id"), by_claim, ["claim_id"], "query_id", "own")
    n_gold = own.join(sizes, "claim_id", "left").select(
        "query_id", (F.coalesce("n_set", F.lit(0)) - F.col("own").cast("long")).alias("n_gold"))
    hits = ranked.select("query_id", "corpus_id", "rank").join(queries.select("query_id", "claim_id"), "query_id")
    return prf_map_at_k(in_sets(hits, by_claim, ["claim_id"], "corpus_id", "is_rel"), n_gold, ks=ks)


def qrels_summary(qrels: DataFrame, *, q_id: str, doc_id: str, level: str) -> DataFrame:
    """S7 + A24: judgements with ``level == 1`` are positive; per query the
    positive set is summarised by size, min and max id."""
    pos = qrels.filter(F.col(level) == 1)
    return pos.groupBy(q_id).agg(F.countDistinct(doc_id).alias("n_relevant"),
                                 F.min(doc_id).alias("min_relevant"),
                                 F.max(doc_id).alias("max_relevant"))


def answer_format_rate(answers: DataFrame, text_col: str) -> DataFrame:
    """Answers lower-cased; exactly ``yes`` / ``no`` or ``H`` (anything
    else); count and share of each."""
    t = F.lower(F.col(text_col))
    cls = F.when(t == "yes", "yes").when(t == "no", "no").otherwise("H")
    c = answers.select(cls.alias("answer")).groupBy("answer").agg(F.count("*").alias("n"))
    total = answers.select(F.count("*")).scalar()
    return c.withColumn("share", F.round(F.col("n") / total, 6))


def queries_with_positives(queries: DataFrame, positives: DataFrame, *, q_id: str = "query_id") -> DataFrame:
    """Each judged query's text with its positive-set summary (inner
    join on the query id; queries without positives are dropped, as in the
    reference's dictionary lookup)."""
    return queries.join(positives, q_id, "inner")

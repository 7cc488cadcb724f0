"""Keys on judged relevance: relevant_sets, judged_retrieval.

Binding: a judgement is a ``labels`` row whose document has an embedding; its claim is
the embedding's label, ``quality`` is the judgement RELEVANCY and ``toxic`` is
evidence_relevant. Claims' texts are the documents of the same id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.idsets import intersect_sets, set_sizes
from ..operators.ireval import judged_metrics, queries_with_positives, relevant_sets
from ..operators.topk import vector_topk
from ..session import cut_lineage
from ..sources.readers import judged_claims, judgements
from .bindings import corpus_from, queries_from, sql_scores
from .registry import Tables, register

LEVELS = ("RELEVANCY", "evidence_relevant")

_SQL_JUDGED = """j AS (
  SELECT DISTINCT e.label::BIGINT AS claim_id, e.vec_id AS doc_id, l.quality, l.toxic
  FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id),
pos AS (
  SELECT DISTINCT 'RELEVANCY' AS level, claim_id, doc_id FROM j WHERE quality = 1 UNION ALL
  SELECT DISTINCT 'evidence_relevant' AS level, claim_id, doc_id FROM j WHERE toxic = 1),
lv AS (SELECT unnest(['RELEVANCY', 'evidence_relevant']) AS level)"""


def _qrels(t: Tables) -> DataFrame:
    return t.labels.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").select(
        F.col("label").cast("long").alias("TOPIC"), F.col("doc_id").alias("DOCUMENT#"),
        F.col("quality").alias("RELEVANCY"), F.col("toxic").alias("evidence_relevant"))


@register("relevant_sets", f"""WITH {_SQL_JUDGED},
shared AS (SELECT claim_id, count(*) AS n_both FROM (SELECT claim_id, doc_id FROM pos GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1)
SELECT level, claim_id, trim(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS claim, count(*) AS n_relevant,
  coalesce(any_value(n_both), 0) AS n_both
FROM pos JOIN documents d ON d.doc_id = claim_id LEFT JOIN shared USING (claim_id) GROUP BY 1, 2, 3""", "S7 J4 J5 A24")
def q_relevant_sets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    qrels = _qrels(t)
    sets = {level: cut_lineage(relevant_sets(judgements(qrels, level))) for level in LEVELS}
    both = set_sizes(intersect_sets(*sets.values(), ["query_id"]), ["query_id"], "n_both")
    claims = t.documents.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("Claim"),
                                F.monotonically_increasing_id().alias("_pos"))
    queries = judged_claims(claims, qrels.select(F.col("TOPIC").alias("claim_id"))) \
        .select(F.col("claim_id").alias("query_id"), F.col("Claim").alias("claim"))
    parts = [queries_with_positives(queries, set_sizes(s, ["query_id"], "n_relevant"))
             .join(both, "query_id", "left").select(
                 F.lit(level).alias("level"), F.col("query_id").alias("claim_id"), "claim", "n_relevant",
                 F.coalesce("n_both", F.lit(0)).alias("n_both")) for level, s in sets.items()]
    return reduce(DataFrame.unionByName, parts)


@register("judged_retrieval", f"""WITH {sql_scores()}, {_SQL_JUDGED},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
                       FROM s) WHERE rank <= 10),
gold AS (SELECT lv.level, e.vec_id AS query_id, count(p.doc_id) AS n_gold
         FROM embeddings e CROSS JOIN lv LEFT JOIN pos p ON p.level = lv.level AND p.claim_id = e.label AND p.doc_id <> e.vec_id
         GROUP BY 1, 2),
rel AS (SELECT lv.level, t.query_id, t.rank, p.doc_id IS NOT NULL AS is_rel
        FROM top t CROSS JOIN lv JOIN embeddings q ON q.vec_id = t.query_id
        LEFT JOIN pos p ON p.level = lv.level AND p.claim_id = q.label AND p.doc_id = t.corpus_id),
r AS (SELECT *, sum(is_rel::INT) OVER (PARTITION BY level, query_id ORDER BY rank
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM rel),
ks AS (SELECT unnest([1, 2, 5, 10]) AS k),
perq AS (SELECT g.level, g.query_id, ks.k, g.n_gold,
                count(r.rank) FILTER (WHERE r.rank <= ks.k) AS n,
                count(r.rank) FILTER (WHERE r.rank <= ks.k AND r.is_rel) AS h,
                coalesce(sum(r.so_far / r.rank) FILTER (WHERE r.rank <= ks.k AND r.is_rel), 0) AS sp
         FROM gold g CROSS JOIN ks LEFT JOIN r ON r.query_id = g.query_id AND r.level = g.level
         GROUP BY g.level, g.query_id, ks.k, g.n_gold)
SELECT level, k::INTEGER AS k,
       round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 6) AS precision,
       round(avg(CASE WHEN n_gold > 0 THEN h / n_gold ELSE 0 END), 6) AS recall,
       round(avg(CASE WHEN n_gold > 0 THEN sp / least(k, n_gold) ELSE 0 END), 6) AS map
FROM perq GROUP BY 1, 2""", "S7 A24 A17 W4 T4")
def q_judged_retrieval(spark, sf_dir):
    t = Tables(spark, sf_dir)
    emb = t.embeddings
    ranked = cut_lineage(vector_topk(queries_from(emb), corpus_from(emb), 10, q_id="query_id", c_id="corpus_id", exclude_self=True)
                         .select("query_id", "corpus_id", "rank"))
    queries = emb.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("claim_id"))
    parts = [judged_metrics(ranked, queries, cut_lineage(relevant_sets(judgements(_qrels(t), level))))
             .select(F.lit(level).alias("level"), "*") for level in LEVELS]
    return reduce(DataFrame.unionByName, parts)

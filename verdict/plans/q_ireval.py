"""Retrieval evaluation keys: hit_at_k, retrieval_prf_map, judged_claims,
retrieval_ablation, two_stage_retrieval, hydrate_evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dims, dot, rounded
from ..operators.ireval import hit_at_k, prf_map_at_k, same_label_relevance
from ..operators.retrieval import hydrate, pools_by_split, two_stage
from ..operators.topk import vector_topk
from .bindings import SQL_GOLD, corpus_from, queries_from, split_of, sql_scores
from .registry import Tables, register


def _hit_at_k_df(spark, sf_dir, vec):
    t = Tables(spark, sf_dir)
    emb = t.embeddings.select("vec_id", "label", vec.alias("embedding"))
    corpus = emb.select(F.col("vec_id").alias("corpus_id"), split_of().alias("split"), "embedding")
    pools = pools_by_split(queries_from(emb), corpus, 100)
    gold = same_label_relevance(emb, id_col="vec_id", label_col="label") \
        .select("query_id", F.col("min_relevant").alias("gold_id"))
    p = pools.join(gold, "query_id", "left") \
        .withColumn("is_gold", F.coalesce(F.col("corpus_id") == F.col("gold_id"), F.lit(False)))
    ranked = two_stage(p, "score", 10, keep=F.col("is_gold"))
    return hit_at_k(ranked, queries_from(emb))


def _sql_hit_at_k(vec_expr: str) -> str:
    return f"""WITH {sql_scores(vec_expr)}, {SQL_GOLD},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, split
                                    ORDER BY score DESC, corpus_id) AS pool_rank FROM s)
         WHERE pool_rank <= 100),
o AS (SELECT p.*, coalesce(p.corpus_id = g.gold_id, false) AS is_gold,
             row_number() OVER (PARTITION BY p.query_id, p.score
                                ORDER BY p.split_rank, p.pool_rank, p.corpus_id) AS dr
      FROM pool p LEFT JOIN gold g USING (query_id)),
surv AS (SELECT *, row_number() OVER (PARTITION BY query_id
                                      ORDER BY score DESC, split_rank, pool_rank, corpus_id) AS rank
         FROM o WHERE dr = 1 OR is_gold),
h AS (SELECT query_id, min(rank) AS gr FROM surv WHERE is_gold AND rank <= 10 GROUP BY query_id),
ks AS (SELECT unnest([1, 2, 5, 10]) AS k)
SELECT k::INTEGER AS k, round(avg(CASE WHEN h.gr <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM embeddings e CROSS JOIN ks LEFT JOIN h ON h.query_id = e.vec_id
GROUP BY k"""


@register("hit_at_k", _sql_hit_at_k("embedding"), "W3 A18 T4")
def q_hit_at_k(spark, sf_dir):
    return _hit_at_k_df(spark, sf_dir, F.col("embedding"))


@register("retrieval_ablation", f"""
SELECT 'full' AS variant, * FROM ({_sql_hit_at_k('embedding')})
UNION ALL
SELECT 'first32' AS variant, * FROM ({_sql_hit_at_k('list_slice(embedding, 1, 32)')})""", "R8 A18")
def q_retrieval_ablation(spark, sf_dir):
    full = _hit_at_k_df(spark, sf_dir, F.col("embedding")).select(F.lit("full").alias("variant"), "*")
    half = _hit_at_k_df(spark, sf_dir, dims("embedding", 1, 32)).select(F.lit("first32").alias("variant"), "*")
    return full.unionByName(half)


@register("retrieval_prf_map", f"""WITH {sql_scores()}, {SQL_GOLD},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
                       FROM s) WHERE rank <= 10),
rel AS (SELECT t.query_id, t.rank, (qe.label = ce.label) AS is_rel
        FROM top t JOIN embeddings qe ON qe.vec_id = t.query_id JOIN embeddings ce ON ce.vec_id = t.corpus_id),
r AS (SELECT *, sum(is_rel::INT) OVER (PARTITION BY query_id ORDER BY rank
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM rel),
ks AS (SELECT unnest([1, 2, 5, 10]) AS k),
perq AS (SELECT g.query_id, ks.k, g.n_gold,
                count(r.rank) FILTER (WHERE r.rank <= ks.k) AS n,
                count(r.rank) FILTER (WHERE r.rank <= ks.k AND r.is_rel) AS h,
                coalesce(sum(r.so_far / r.rank) FILTER (WHERE r.rank <= ks.k AND r.is_rel), 0) AS sp
         FROM gold g CROSS JOIN ks LEFT JOIN r ON r.query_id = g.query_id
         GROUP BY g.query_id, ks.k, g.n_gold)
SELECT k::INTEGER AS k,
       round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 6) AS precision,
       round(avg(CASE WHEN n_gold > 0 THEN h / n_gold ELSE 0 END), 6) AS recall,
       round(avg(CASE WHEN n_gold > 0 THEN sp / least(k, n_gold) ELSE 0 END), 6) AS map
FROM perq GROUP BY k""", "A17 W4 T4")
def q_retrieval_prf_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    emb = t.embeddings
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    c = emb.select(F.col("vec_id").alias("corpus_id"), "embedding", "label")
    top = vector_topk(q, c, 10, q_id="query_id", c_id="corpus_id", exclude_self=True,
                      q_payload={"label": "ql"}, c_payload={"label": "cl"})
    ranked = top.withColumn("is_rel", F.col("ql") == F.col("cl"))
    ng = same_label_relevance(emb, id_col="vec_id", label_col="label") \
        .select("query_id", F.col("n_relevant").alias("n_gold"))
    return prf_map_at_k(ranked, ng)


@register("judged_claims", f"""WITH {SQL_GOLD}
SELECT query_id, n_gold AS n_relevant, gold_id AS min_relevant, max_id AS max_relevant FROM gold""",
          "S7 J4 J5 A24")
def q_judged_claims(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return same_label_relevance(t.embeddings, id_col="vec_id", label_col="label")


_SQL_TWO_STAGE = f"""WITH {sql_scores()},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, split
                                    ORDER BY score DESC, corpus_id) AS pool_rank FROM s)
         WHERE pool_rank <= 25),
rs AS (SELECT p.*, round(list_dot_product(list_slice(qv.v, 1, 16), list_slice(cv.v, 1, 16)), 6) AS score2
       FROM pool p JOIN vecs qv ON qv.vec_id = p.query_id JOIN vecs cv ON cv.vec_id = p.corpus_id),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, score2
                                    ORDER BY split_rank, pool_rank, corpus_id) AS dr FROM rs) WHERE dr = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                                    ORDER BY score2 DESC, split_rank, pool_rank, corpus_id) AS rank FROM d)
        WHERE rank <= 5)"""


def _two_stage_df(spark, sf_dir):
    t = Tables(spark, sf_dir)
    emb = t.embeddings
    corpus = emb.select(F.col("vec_id").alias("corpus_id"), split_of().alias("split"), "embedding")
    pools = pools_by_split(queries_from(emb), corpus, 25)
    # the re-scorer's 16 dims are joined to the pool rows after the cut
    qv = emb.select(F.col("vec_id").alias("query_id"), dims("embedding", 1, 16).alias("qv"))
    cv = emb.select(F.col("vec_id").alias("corpus_id"), dims("embedding", 1, 16).alias("cv"))
    rs = pools.join(qv, "query_id").join(cv, "corpus_id") \
        .withColumn("score2", rounded(dot("qv", "cv"))).drop("qv", "cv")
    return two_stage(rs, "score2", 5)


@register("two_stage_retrieval", f"""{_SQL_TWO_STAGE}
SELECT t.query_id, t.rank, t.corpus_id, t.split, t.score2, d.lang
FROM top t JOIN (SELECT doc_id, CASE WHEN count(lang) = count(*) THEN min(lang) END AS lang FROM documents GROUP BY doc_id) d
  ON d.doc_id = t.corpus_id""", "R2 J1 U1 W1 W2")
def q_two_stage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    top = _two_stage_df(spark, sf_dir)
    docs = t.documents.select("doc_id", "lang")
    h = hydrate(top, docs, hit_key=["corpus_id"], content_key=["doc_id"], order=["lang"])
    return h.select("query_id", "rank", "corpus_id", "split", "score2", "lang")


@register("hydrate_evidence", f"""WITH {sql_scores()},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
                       FROM s) WHERE rank <= 5)
SELECT t.query_id, t.rank, t.score, d.doc_id, d.lang, d.source, d.n_chars
FROM top t JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars NULLS FIRST, lang NULLS FIRST,
    source NULLS FIRST) AS nth FROM documents) d ON d.doc_id = t.corpus_id AND d.nth = 1""", "J2 J3 J7")
def q_hydrate_evidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    emb = t.embeddings
    top = vector_topk(queries_from(emb), corpus_from(emb), 5, q_id="query_id", c_id="corpus_id",
                      exclude_self=True)
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    h = hydrate(top, docs, hit_key=["corpus_id"], content_key=["doc_id"], order=["n_chars", "lang", "source"])
    return h.select("query_id", "rank", "score", "doc_id", "lang", "source", "n_chars")

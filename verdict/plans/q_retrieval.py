"""Vector retrieval keys: J11 F1 W1 W2 R3."""

from __future__ import annotations

from ..operators.topk import vector_topk
from .bindings import SQL_VECS, corpus_from, queries_from, sql_cos
from .registry import Tables, register

_SQL_SCORES = f"""WITH {SQL_VECS},
s AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
             {sql_cos('q.v', 'c.v', 'q.n', 'c.n')} AS score
      FROM vecs q, vecs c WHERE q.vec_id <> c.vec_id)"""


@register("vector_topk", f"""{_SQL_SCORES}
SELECT query_id, corpus_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM s)
WHERE rank <= 5""", "J11 F1 W1")
def q_vector_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vector_topk(queries_from(t.embeddings), corpus_from(t.embeddings), 5,
                       q_id="query_id", c_id="corpus_id", exclude_self=True)


@register("image_retrieval", f"""{_SQL_SCORES},
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, score ORDER BY corpus_id) AS dr FROM s)
      WHERE dr = 1)
SELECT query_id, corpus_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM d)
WHERE rank <= 50""", "R3 J11 W2 W1")
def q_image_retrieval(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # k = 50: the reference's default for image retrieval
    return vector_topk(queries_from(t.embeddings), corpus_from(t.embeddings), 50,
                       q_id="query_id", c_id="corpus_id", exclude_self=True, dedup_scores=True)

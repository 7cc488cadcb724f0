"""Verdict keys: four_path_fold, claim_verdict, majority_vote,
two_level_verdict.

Evidence = nearest neighbours of each claim embedding; a neighbour's label
stands for the answer / verdict a model would have produced on the pair.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import fold_paths, verdict_of_code
from ..functions.vectors import dims
from ..operators.votes import claim_verdict, majority_vote, two_level_verdict
from .bindings import neighbours, sql_neighbours, sql_scores
from ..session import cut_lineage
from .registry import Tables, register

_SQL_VERDICT3 = "CASE {x} WHEN 0 THEN 'support' WHEN 1 THEN 'not_enough_information' ELSE 'refute' END"


def _path_pred(c):
    """Path prediction from one logit: > 0.05 support, < -0.05 refute,
    |x| < 0.01 missing (null), otherwise NEI."""
    return (F.when(F.abs(c) < 0.01, F.lit(None).cast("string"))
            .when(c > 0.05, "support").when(c < -0.05, "refute").otherwise("not_enough_information"))


def _sql_path_pred(x: str) -> str:
    return (f"CASE WHEN abs({x}) < 0.01 THEN NULL WHEN {x} > 0.05 THEN 'support' "
            f"WHEN {x} < -0.05 THEN 'refute' ELSE 'not_enough_information' END")


def _sql_resolve(a: str, b: str) -> str:
    return (f"CASE WHEN {a} = {b} AND {a} IN ('support','refute') THEN {a} "
            f"WHEN {a} IN ('support','refute') AND {b} = 'not_enough_information' THEN {a} "
            f"WHEN {b} IN ('support','refute') AND {a} = 'not_enough_information' THEN {b} "
            f"ELSE 'not_enough_information' END")


def sql_fold(tt: str, ti: str, it: str, ii: str) -> str:
    n = [f"coalesce({x}, 'not_enough_information')" for x in (tt, ti, it, ii)]
    first = _sql_resolve(n[0], n[3])
    return f"CASE WHEN ({first}) <> 'not_enough_information' THEN ({first}) ELSE ({_sql_resolve(n[1], n[2])}) END"


@register("four_path_fold", f"""
WITH p AS (SELECT vec_id, {_sql_path_pred('embedding[1]')} AS text_text,
                  {_sql_path_pred('embedding[2]')} AS text_image,
                  {_sql_path_pred('embedding[3]')} AS image_text,
                  {_sql_path_pred('embedding[4]')} AS image_image FROM embeddings)
SELECT vec_id, text_text, text_image, image_text, image_image,
       {sql_fold('text_text', 'text_image', 'image_text', 'image_image')} AS final
FROM p""", "F9 P21")
def q_four_path_fold(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    p = e.select("vec_id", *[_path_pred(F.col("embedding")[i]).alias(n) for i, n in
                             enumerate(["text_text", "text_image", "image_text", "image_image"])])
    return p.withColumn("final", fold_paths("text_text", "text_image", "image_text", "image_image"))


# from all claims, so that one without evidence keeps its row
_SQL_EVERY_CLAIM = """SELECT q.query_id, coalesce(f.verdict, 'not_enough_information') AS verdict,
       coalesce(f.n_support, 0) AS n_support, coalesce(f.n_refute, 0) AS n_refute, coalesce(f.n_nei, 0) AS n_nei,
       coalesce(string_agg(ev.pos::VARCHAR, ',' ORDER BY ev.pos) FILTER (WHERE ev.v = f.verdict), '')
         AS contributing
FROM (SELECT DISTINCT vec_id AS query_id FROM embeddings) q
LEFT JOIN f ON f.query_id = q.query_id LEFT JOIN ev ON ev.query_id = q.query_id
GROUP BY q.query_id, f.verdict, f.n_support, f.n_refute, f.n_nei"""


@register("claim_verdict", f"""WITH {sql_neighbours(3, 'list_slice(embedding, 1, 32)', 'tx')},
{sql_neighbours(2, 'list_slice(embedding, 33, 64)', 'im')},
ev AS (SELECT query_id, rank AS pos, {_SQL_VERDICT3.format(x='c_label % 3')} AS v FROM tx
       UNION ALL
       SELECT query_id, 3 + rank AS pos, {_SQL_VERDICT3.format(x='c_label % 3')} AS v FROM im),
g AS (SELECT query_id, count(*) FILTER (WHERE v = 'support') AS n_support,
             count(*) FILTER (WHERE v = 'refute') AS n_refute,
             count(*) FILTER (WHERE v = 'not_enough_information') AS n_nei FROM ev GROUP BY query_id),
f AS (SELECT *, CASE WHEN n_support = 0 AND n_refute = 0 THEN 'not_enough_information'
                     WHEN n_support = n_refute THEN 'not_enough_information'
                     WHEN n_support > n_refute THEN 'support' ELSE 'refute' END AS verdict FROM g)
{_SQL_EVERY_CLAIM}""", "A8 U2")
def q_claim_verdict(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    tx = neighbours(e, 3, dims("embedding", 1, 32)).select("query_id", "rank", "c_label",
                                                            F.lit(0).alias("modality"))
    im = neighbours(e, 2, dims("embedding", 33, 32)).select("query_id", "rank", "c_label",
                                                             F.lit(1).alias("modality"))
    ev = tx.unionByName(im)
    w = Window.partitionBy("query_id").orderBy("modality", "rank")
    ev = ev.withColumn("pos", F.row_number().over(w)).withColumn("v", verdict_of_code(F.col("c_label") % 3))
    return claim_verdict(ev, claim="query_id", position="pos", verdict="v", claims=_claims(e))


def _claims(embeddings):
    return embeddings.select(F.col("vec_id").alias("query_id"))


_SQL_VOTE = """SELECT query_id, label AS final_label, votes, max_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, max_score DESC, label) AS rn
  FROM (SELECT query_id, label, count(*) AS votes, max(score) AS max_score FROM {src} GROUP BY query_id, label))
WHERE rn = 1"""


@register("majority_vote", f"""WITH {sql_neighbours(5)},
a AS (SELECT query_id, CASE WHEN c_label % 2 = 0 THEN 'supported' ELSE 'refuted' END AS label, score FROM nn)
, v AS ({_SQL_VOTE.format(src='a')})
SELECT q.query_id, coalesce(final_label, 'NEI') AS final_label, coalesce(votes, 0) AS votes, max_score
FROM (SELECT DISTINCT vec_id AS query_id FROM embeddings) q LEFT JOIN v ON v.query_id = q.query_id""", "A6 T2")
def q_majority_vote(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    a = neighbours(e, 5).select("query_id", F.when(F.col("c_label") % 2 == 0, "supported")
                                .otherwise("refuted").alias("label"), "score")
    return majority_vote(a, claim="query_id", label="label", score="score", claims=_claims(e))


@register("two_level_verdict", f"""WITH {sql_neighbours(5)},
l1 AS (SELECT query_id, CASE WHEN c_label % 3 = 1 THEN 'NEI' ELSE 'yes' END AS label, score FROM nn),
v1 AS ({_SQL_VOTE.format(src='l1')}),
l2 AS (SELECT query_id, CASE WHEN c_label % 2 = 0 THEN 'supported' ELSE 'refuted' END AS label, score
       FROM nn WHERE query_id IN (SELECT query_id FROM v1 WHERE final_label <> 'NEI')),
v2 AS ({_SQL_VOTE.format(src='l2')})
SELECT q.query_id, coalesce(v2.final_label, 'NEI') AS final_label,
       CASE WHEN v1.final_label <> 'NEI' THEN 2 ELSE 1 END AS level
FROM (SELECT DISTINCT vec_id AS query_id FROM embeddings) q
LEFT JOIN v1 ON v1.query_id = q.query_id LEFT JOIN v2 ON v2.query_id = q.query_id""", "A7 R7 U3")
def q_two_level_verdict(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    # both levels vote over the same evidence: materialise the (k per claim)
    # neighbour table once instead of running the all-pairs search twice
    nn = cut_lineage(neighbours(e, 5).select("query_id", "c_label", "score"))
    l1 = nn.select("query_id", F.when(F.col("c_label") % 3 == 1, "NEI").otherwise("yes").alias("label"), "score")
    l2 = nn.select("query_id", F.when(F.col("c_label") % 2 == 0, "supported")
                   .otherwise("refuted").alias("label"), "score")
    return two_level_verdict(l1, l2, claim="query_id", label="label", score="score", claims=_claims(e))


def _sql_path(i: int) -> str:
    l0, l1, l2 = (f"(qe.embedding[{3 * i + j + 1}]::DOUBLE + ce.embedding[{3 * i + j + 1}]::DOUBLE)"
                  for j in range(3))
    return (f"CASE WHEN {l0} >= {l1} AND {l0} >= {l2} THEN 'support' WHEN {l1} >= {l2} "
            f"THEN 'not_enough_information' ELSE 'refute' END")


_SQL_VERIFY = f"""WITH {sql_scores('list_slice(embedding, 1, 32)', 'tx')},
tpool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, split
                                     ORDER BY score DESC, corpus_id) AS pool_rank FROM tx) WHERE pool_rank <= 15),
trs AS (SELECT p.*, round(list_dot_product(list_slice(qe.embedding::DOUBLE[], 1, 16),
                                           list_slice(ce.embedding::DOUBLE[], 1, 16)), 6) AS score2
        FROM tpool p JOIN embeddings qe ON qe.vec_id = p.query_id JOIN embeddings ce ON ce.vec_id = p.corpus_id),
tdd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, score2
                                  ORDER BY split_rank, pool_rank, corpus_id) AS dr FROM trs) WHERE dr = 1),
th AS (SELECT * FROM (SELECT query_id, corpus_id, row_number() OVER (PARTITION BY query_id
                       ORDER BY score2 DESC, split_rank, pool_rank, corpus_id) AS rank FROM tdd) WHERE rank <= 3),
{sql_scores('list_slice(embedding, 33, 64)', 'im')},
idd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, score ORDER BY corpus_id) AS dr
                       FROM im) WHERE dr = 1),
ih AS (SELECT * FROM (SELECT query_id, corpus_id, row_number() OVER (PARTITION BY query_id
                       ORDER BY score DESC, corpus_id) AS rank FROM idd) WHERE rank <= 2),
hits AS (SELECT *, 0 AS modality FROM th UNION ALL SELECT *, 1 AS modality FROM ih),
ev0 AS (SELECT h.* FROM hits h WHERE h.corpus_id IN (SELECT doc_id FROM documents)),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY modality, rank) AS pos FROM ev0),
img AS (SELECT DISTINCT doc_id FROM labels),
ev2 AS (SELECT ev1.query_id, ev1.pos,
               {_sql_path(0)} AS text_text,
               CASE WHEN ev1.corpus_id IN (SELECT doc_id FROM img) THEN {_sql_path(1)} END AS text_image,
               CASE WHEN ev1.query_id IN (SELECT doc_id FROM img) THEN {_sql_path(2)} END AS image_text,
               CASE WHEN ev1.query_id IN (SELECT doc_id FROM img) AND ev1.corpus_id IN (SELECT doc_id FROM img)
                    THEN {_sql_path(3)} END AS image_image
        FROM ev1 JOIN embeddings qe ON qe.vec_id = ev1.query_id JOIN embeddings ce ON ce.vec_id = ev1.corpus_id),
ev AS (SELECT query_id, pos, {sql_fold('text_text', 'text_image', 'image_text', 'image_image')} AS v FROM ev2),
g AS (SELECT query_id, count(*) FILTER (WHERE v = 'support') AS n_support,
             count(*) FILTER (WHERE v = 'refute') AS n_refute,
             count(*) FILTER (WHERE v = 'not_enough_information') AS n_nei FROM ev GROUP BY query_id),
f AS (SELECT *, CASE WHEN n_support = 0 AND n_refute = 0 THEN 'not_enough_information'
                     WHEN n_support = n_refute THEN 'not_enough_information'
                     WHEN n_support > n_refute THEN 'support' ELSE 'refute' END AS verdict FROM g)
{_SQL_EVERY_CLAIM}"""


@register("verify_claims", _SQL_VERIFY, "R6 R2 R3 J2 J3 F2 P21 F9 A8")
def q_verify_claims(spark, sf_dir):
    from .verify import verify_claims
    t = Tables(spark, sf_dir)
    return verify_claims(t.embeddings, t.documents, t.labels)

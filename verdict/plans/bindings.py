"""How the operators bind to the supplied tables (shared by several keys).

claims / queries = every ``embeddings`` row; evidence / corpus = every
``embeddings`` row except the claim itself; split = ``test`` for
``vec_id % 5 = 1`` else ``train`` (an attribute, no row is dropped);
relevance = equal ``label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SQL fragment: the same binding for the oracle.
SQL_VECS = """vecs AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings)"""


def sql_cos(a: str, b: str, na: str | None = None, nb: str | None = None) -> str:
    na = na or f"sqrt(list_dot_product({a}, {a}))"
    nb = nb or f"sqrt(list_dot_product({b}, {b}))"
    return f"round(list_dot_product({a}, {b}) / (greatest({na}, 1e-6) * greatest({nb}, 1e-6)), 6)"


def queries_from(emb: DataFrame, vec: str = "embedding") -> DataFrame:
    return emb.select(F.col("vec_id").alias("query_id"), F.col(vec).alias("embedding"))


def corpus_from(emb: DataFrame, vec: str = "embedding") -> DataFrame:
    return emb.select(F.col("vec_id").alias("corpus_id"), F.col(vec).alias("embedding"))


def split_of(id_col: str = "vec_id"):
    return F.when(F.col(id_col) % 5 == 1, F.lit("test")).otherwise(F.lit("train"))


SQL_SPLIT = "CASE WHEN vec_id % 5 = 1 THEN 'test' ELSE 'train' END"


def sql_scores(vec_expr: str = "embedding", name: str = "s") -> str:
    """CTEs ``vecs`` and ``{name}``: cosine of every ordered pair of distinct
    embeddings, rounded to 6, with the corpus split."""
    vn = "vecs" if name == "s" else f"{name}_vecs"
    return f"""{vn} AS (
  SELECT vec_id, label, {SQL_SPLIT} AS split,
         CASE WHEN vec_id % 5 = 1 THEN 1 ELSE 0 END AS split_rank,
         ({vec_expr})::DOUBLE[] AS v,
         sqrt(list_dot_product(({vec_expr})::DOUBLE[], ({vec_expr})::DOUBLE[])) AS n
  FROM embeddings),
{name} AS (
  SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, c.split, c.split_rank,
         {sql_cos('q.v', 'c.v', 'q.n', 'c.n')} AS score
  FROM {vn} q, {vn} c WHERE q.vec_id <> c.vec_id)"""


SQL_GOLD = """gold AS (
  SELECT q.vec_id AS query_id, count(c.vec_id) AS n_gold, min(c.vec_id) AS gold_id,
         max(c.vec_id) AS max_id
  FROM embeddings q LEFT JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id)"""


def neighbours(emb: DataFrame, k: int, vec=None) -> DataFrame:
    """Top-k neighbours of every embedding (itself excluded) with their
    labels: ``query_id, corpus_id, score, rank, q_label, c_label``."""
    from ..operators.topk import vector_topk
    v = vec if vec is not None else F.col("embedding")
    e = emb.select("vec_id", v.alias("embedding"), "label")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    c = e.select(F.col("vec_id").alias("corpus_id"), "embedding", "label")
    # labels travel with the rows through the grid: no join back to emb
    return vector_topk(q, c, k, q_id="query_id", c_id="corpus_id", exclude_self=True,
                       q_payload={"label": "q_label"}, c_payload={"label": "c_label"})


def sql_neighbours(k: int, vec_expr: str = "embedding", name: str = "nn") -> str:
    return f"""{sql_scores(vec_expr, name + '_s')},
{name} AS (SELECT t.*, qe.label AS q_label, ce.label AS c_label FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
    FROM {name}_s) t
  JOIN embeddings qe ON qe.vec_id = t.query_id JOIN embeddings ce ON ce.vec_id = t.corpus_id
  WHERE t.rank <= {k})"""

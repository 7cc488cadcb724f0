"""Answer-scoring and re-rank keys.

Token logits = the whole ``embedding``: tokens 1-2 spell yes, 3-4 no,
5-6 none. Answers for re-ranking come from ``events``: per user (query) and
event (candidate), view / click -> yes, error -> no, anything else its
type; the answer score is ``least(value / 500, 1)``; the first-stage score is
``props.k / 100``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.answers import (generated_token_prob, group_answer, rerank_score2, rerank_score3,
                                 rerank_yes_flag)
from ..operators.ireval import answer_format_rate
from .registry import Tables, register

YES, NO, NONE = [1, 2], [3, 4], [5, 6]
#: the embeddings with the softmax weights ``w`` of the whole vector and their sum ``t``
_WHOLE = """(SELECT vec_id, embedding, w, list_sum(w) AS t FROM (
  SELECT vec_id, embedding,
         list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS w FROM embeddings))"""


def _z(i: int) -> str:
    return f"embedding[{i}]::DOUBLE"


def _sql_softmax(positions: list[int]) -> dict[int, str]:
    m = "greatest(" + ", ".join(_z(p) for p in positions) + ")"
    tot = " + ".join(f"exp({_z(p)} - {m})" for p in positions)
    return {p: f"(exp({_z(p)} - {m}) / ({tot}))" for p in positions}


def _sql_group(groups: dict[str, list[int]], whole: bool = False, other: str | None = None) -> tuple[str, str]:
    pos = [p for ps in groups.values() for p in ps]
    pr = {p: f"(w[{p}] / t)" for p in pos} if whole else _sql_softmax(pos)
    sums = ["(" + " + ".join(pr[p] for p in ps) + ")" for ps in groups.values()]
    labels = list(groups)
    if other:
        sums.append("(1.0 - (" + " + ".join(sums) + "))")
        labels.append(other)
    best = "greatest(" + ", ".join(sums) + ")"
    lab = "CASE " + " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in zip(labels[:-1], sums[:-1])) \
        + f" ELSE '{labels[-1]}' END"
    return lab, best


def _spark_answer(spark, sf_dir, **kw):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id", group_answer(F.col("embedding"), **kw).alias("a"))


_YN_L, _YN_S = _sql_group({"yes": YES, "no": NO})


@register("answer_score_yn", f"""SELECT vec_id, label_yn,
  CASE label_yn WHEN 'yes' THEN 'yes' ELSE 'NEI' END AS label_level1,
  CASE label_yn WHEN 'yes' THEN 'supported' ELSE 'refuted' END AS label_binary, round(score, 6) AS score
FROM (SELECT vec_id, {_YN_L} AS label_yn, {_YN_S} AS score FROM embeddings)""", "F3")
def q_answer_score_yn(spark, sf_dir):
    a = _spark_answer(spark, sf_dir, groups={"yes": YES, "no": NO})
    lab = F.col("a.label")
    return a.select("vec_id", lab.alias("label_yn"),
                    F.when(lab == "yes", "yes").otherwise("NEI").alias("label_level1"),
                    F.when(lab == "yes", "supported").otherwise("refuted").alias("label_binary"),
                    F.round("a.score", 6).alias("score"))


_YNO_L, _YNO_S = _sql_group({"yes": YES, "no": NO}, whole=True)
_YNOB_L, _YNOB_S = _sql_group({"supported": YES, "refuted": NO}, whole=True, other="NEI")


@register("answer_score_yno", f"""SELECT vec_id, {_YNO_L} AS label_4a, round({_YNO_S}, 6) AS score_4a,
  {_YNOB_L} AS label_4b, round({_YNOB_S}, 6) AS score_4b FROM {_WHOLE}""", "F4a F4b")
def q_answer_score_yno(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    a = group_answer(F.col("embedding"), {"yes": YES, "no": NO}, whole=True)
    b = group_answer(F.col("embedding"), {"supported": YES, "refuted": NO}, whole=True, other="NEI")
    return e.select("vec_id", a["label"].alias("label_4a"), F.round(a["score"], 6).alias("score_4a"),
                    b["label"].alias("label_4b"), F.round(b["score"], 6).alias("score_4b"))


_YNN_L, _YNN_S = _sql_group({"supported": YES, "refuted": NO, "NEI": NONE})


@register("answer_score_ynn", f"""SELECT vec_id, {_YNN_L} AS label, round({_YNN_S}, 6) AS score
FROM embeddings""", "F5")
def q_answer_score_ynn(spark, sf_dir):
    a = _spark_answer(spark, sf_dir, groups={"supported": YES, "refuted": NO, "NEI": NONE})
    return a.select("vec_id", F.col("a.label").alias("label"), F.round("a.score", 6).alias("score"))


@register("answer_score_token", f"""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS token,
  round(w[list_position(embedding, list_max(embedding))] / t, 6) AS prob FROM {_WHOLE}""", "F6 T5")
def q_answer_score_token(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    g = generated_token_prob(F.col("embedding"))
    return e.select("vec_id", g["token"].alias("token"), F.round(g["prob"], 6).alias("prob"))


def _llm_answers(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    text = F.when(F.col("event_type").isin("view", "click"), "yes") \
        .when(F.col("event_type") == "error", "no").otherwise(F.col("event_type"))
    return ev.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_id"),
                     text.alias("generated_text"),
                     F.least(F.col("value") / 500.0, F.lit(1.0)).alias("answer_score"))


def _first_stage(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_id"),
                     (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("score"))


_SQL_LLM = """a AS (SELECT user_id AS query_id, event_id AS candidate_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'yes' WHEN event_type = 'error' THEN 'no' ELSE event_type END
    AS generated_text, least(value / 500.0, 1.0) AS answer_score,
  json_extract(props, '$.k')::DOUBLE / 100.0 AS first_score FROM events)"""
_SQL_TOP10 = """SELECT query_id, rank, candidate_id, score FROM (
  SELECT query_id, candidate_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM r)
WHERE rank <= 10"""


def _top10(df):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10") \
        .select("query_id", "rank", "candidate_id", "score")


@register("rerank_llm", f"""WITH {_SQL_LLM},
r AS (SELECT query_id, candidate_id,
             CASE WHEN lower(generated_text) = 'yes' THEN 1.0 ELSE 0.0001 END * first_score AS score FROM a)
{_SQL_TOP10}""", "F7a J12 T4")
def q_rerank_llm(spark, sf_dir):
    a = _llm_answers(spark, sf_dir)
    j = a.join(_first_stage(spark, sf_dir), ["query_id", "candidate_id"])  # J12 by key, not position
    return _top10(j.select("query_id", "candidate_id",
                           rerank_yes_flag(F.col("generated_text"), F.col("score")).alias("score")))


@register("rerank_score3", f"""WITH {_SQL_LLM},
r AS (SELECT query_id, candidate_id, CASE
    WHEN generated_text = 'yes' THEN CASE WHEN answer_score >= 0 THEN answer_score ELSE answer_score + 1 END
    WHEN generated_text = 'no' THEN CAST(0.00001 AS DOUBLE) * CASE WHEN answer_score > 0 THEN 1 - answer_score ELSE -answer_score END
    ELSE 0.0 END AS score FROM a)
{_SQL_TOP10}""", "F7b")
def q_rerank_score3(spark, sf_dir):
    a = _llm_answers(spark, sf_dir)
    return _top10(a.select("query_id", "candidate_id",
                           rerank_score3(F.col("generated_text"), F.col("answer_score")).alias("score")))


@register("rerank_score2", f"""WITH {_SQL_LLM},
r AS (SELECT query_id, candidate_id, CASE
    WHEN generated_text = 'yes' THEN CASE WHEN answer_score > 0 THEN answer_score ELSE answer_score + 1 END
    ELSE CAST(0.00001 AS DOUBLE) * CASE WHEN answer_score >= 0 THEN 1 - answer_score ELSE -answer_score END
    END AS score FROM a)
{_SQL_TOP10}""", "F7c")
def q_rerank_score2(spark, sf_dir):
    a = _llm_answers(spark, sf_dir)
    return _top10(a.select("query_id", "candidate_id",
                           rerank_score2(F.col("generated_text"), F.col("answer_score")).alias("score")))


@register("answer_format_rate", f"""WITH {_SQL_LLM},
c AS (SELECT CASE WHEN lower(generated_text) = 'yes' THEN 'yes' WHEN lower(generated_text) = 'no' THEN 'no'
             ELSE 'H' END AS answer, count(*) AS n FROM a GROUP BY 1)
SELECT answer, n, round(n / sum(n) OVER (), 6) AS share FROM c""", "A19")
def q_answer_format_rate(spark, sf_dir):
    return answer_format_rate(_llm_answers(spark, sf_dir), "generated_text")

"""Ensemble, pooling and evidence-product keys.

Three "models" = softmax of embedding dims 1-5, 6-10, 11-15, each its own
table keyed by vec_id (joined by key, J13); truth = ``label % 5`` in the
ensemble vocabulary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dims, softmax
from ..operators.ensemble import blend, grid_search
from ..operators.retrieval import attach_external
from ..schemas import ENSEMBLE_CATEGORIES, ENSEMBLE_POWERS, ENSEMBLE_SETTING, ENSEMBLE_WEIGHTS
from .bindings import neighbours, sql_neighbours
from .registry import Tables, register


def _models(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    ms = [e.select("vec_id", softmax(dims("embedding", 5 * i + 1, 5)).alias(f"m{i + 1}")) for i in range(3)]
    truth = e.select("vec_id", (F.col("label") % 5).cast("int").alias("y"))
    return truth.join(ms[0], "vec_id").join(ms[1], "vec_id").join(ms[2], "vec_id")


def _sql_probs(i: int) -> str:
    zs = [f"embedding[{5 * i + j + 1}]::DOUBLE" for j in range(5)]
    m = "greatest(" + ", ".join(zs) + ")"
    tot = " + ".join(f"exp({z} - {m})" for z in zs)
    return "[" + ", ".join(f"exp({z} - {m}) / ({tot})" for z in zs) + "]"


_SQL_PROBS = f"""pr AS (SELECT vec_id, (label % 5)::INTEGER AS y, {_sql_probs(0)} AS a, {_sql_probs(1)} AS b,
                        {_sql_probs(2)} AS c FROM embeddings)"""
_CATS = "CASE {x} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ENSEMBLE_CATEGORIES)) + " END"


def _sql_blend(w, p) -> str:
    sc = [f"round({w[0]} * pow(a[{c}], {p[0]}) + {w[1]} * pow(b[{c}], {p[1]}) + {w[2]} * pow(c[{c}], {p[2]}), 9)"
          for c in range(1, 6)]
    return "[" + ", ".join(sc) + "]"


@register("ensemble_predict", f"""WITH {_SQL_PROBS},
s AS (SELECT vec_id, y, {_sql_blend(ENSEMBLE_SETTING['w'], ENSEMBLE_SETTING['p'])} AS s FROM pr)
SELECT vec_id, {_CATS.format(x='list_position(s, list_max(s)) - 1')} AS pred, {_CATS.format(x='y')} AS truth
FROM s""", "F8 J13 T5")
def q_ensemble_predict(spark, sf_dir):
    m = _models(spark, sf_dir)
    code = blend([F.col("m1"), F.col("m2"), F.col("m3")], ENSEMBLE_SETTING["w"], ENSEMBLE_SETTING["p"], 5)
    names = F.array(*[F.lit(c) for c in ENSEMBLE_CATEGORIES])
    return m.select("vec_id", F.element_at(names, code + 1).alias("pred"),
                    F.element_at(names, F.col("y") + 1).alias("truth"))


def _sql_grid() -> str:
    ws = ", ".join(str(float(x)) for x in ENSEMBLE_WEIGHTS)
    ps = ", ".join(repr(float(x)) for x in ENSEMBLE_POWERS)
    nw, npw = len(ENSEMBLE_WEIGHTS), len(ENSEMBLE_POWERS)
    k5 = range(1, 6)
    pows = ", ".join(f"pow(a[{k}], p1.p) AS a{k}, pow(b[{k}], p2.p) AS b{k}, pow(c[{k}], p3.p) AS c{k}" for k in k5)
    scores = ", ".join(f"round(w1 * a{k} + w2 * b{k} + w3 * c{k}, 9) AS s{k}" for k in k5)
    first_max = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"s{k} >= s{j}" for j in range(k + 1, 6)) + f" THEN {k - 1}" for k in range(1, 5)
    ) + " ELSE 4 END"
    return f"""{_SQL_PROBS},
wv AS (SELECT unnest([{ws}]::DOUBLE[]) AS w, unnest(range({nw})) AS wi),
pv AS (SELECT unnest([{ps}]::DOUBLE[]) AS p, unnest(range({npw})) AS pi),
powd AS (SELECT pr.y, p1.pi AS i1, p2.pi AS i2, p3.pi AS i3, {pows} FROM pr, pv p1, pv p2, pv p3),
ww AS (SELECT w1.w AS w1, w2.w AS w2, w3.w AS w3, w1.wi AS j1, w2.wi AS j2, w3.wi AS j3
       FROM wv w1, wv w2, wv w3),
sc AS (SELECT ((((j1 * {nw} + j2) * {nw} + j3) * {npw} + i1) * {npw} + i2) * {npw} + i3 AS sid, y, {scores}
       FROM powd, ww),
pd AS (SELECT sid, y, {first_max} AS p FROM sc),
sup AS (SELECT y AS cls, count(*) AS support FROM pr GROUP BY y),
cnt AS (SELECT sid, p AS cls, count(*) FILTER (WHERE p = y) AS tp, count(*) AS npred FROM pd GROUP BY sid, p),
f AS (SELECT g.sid, round(sum(CASE WHEN coalesce(sup.support, 0) + coalesce(cnt.npred, 0) > 0
                        THEN coalesce(sup.support, 0) * 2 * coalesce(cnt.tp, 0)
                             / (coalesce(sup.support, 0) + coalesce(cnt.npred, 0)) ELSE 0 END)
                        / (SELECT count(*) FROM pr), 5) AS f1
      FROM (SELECT DISTINCT sid FROM cnt) g CROSS JOIN sup LEFT JOIN cnt ON cnt.sid = g.sid AND cnt.cls = sup.cls
      GROUP BY g.sid),
best AS (SELECT sid, f1 FROM f ORDER BY f1 DESC, sid LIMIT 1)
SELECT CASE WHEN f1 <= 0 THEN 0.0 ELSE f1 END AS best_f1,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE ([{ws}]::DOUBLE[])[(sid // {nw * nw * npw ** 3}) % {nw} + 1] END AS w1,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE ([{ws}]::DOUBLE[])[(sid // {nw * npw ** 3}) % {nw} + 1] END AS w2,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE ([{ws}]::DOUBLE[])[(sid // {npw ** 3}) % {nw} + 1] END AS w3,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE ([{ps}]::DOUBLE[])[(sid // {npw ** 2}) % {npw} + 1] END AS p1,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE ([{ps}]::DOUBLE[])[(sid // {npw}) % {npw} + 1] END AS p2,
       CASE WHEN f1 <= 0 THEN 0.0 ELSE ([{ps}]::DOUBLE[])[sid % {npw} + 1] END AS p3,
       CASE WHEN f1 <= 0 THEN -1 ELSE sid END AS setting
FROM best"""


@register("ensemble_grid", "WITH " + _sql_grid(), "A26 A10 F8 F14")
def q_ensemble_grid(spark, sf_dir):
    return grid_search(_models(spark, sf_dir))


@register("mean_pool", """SELECT label, pos, round(avg(v), 6) AS mean FROM (
  SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
GROUP BY label, pos""", "A23")
def q_mean_pool(spark, sf_dir):
    from ..operators.pooling import mean_pool
    e = Tables(spark, sf_dir).embeddings
    return mean_pool(e, key="label", vec="embedding")


@register("evidence_product", f"""WITH {sql_neighbours(3, 'list_slice(embedding, 1, 32)', 'tx')},
{sql_neighbours(2, 'list_slice(embedding, 33, 64)', 'im')}
SELECT tx.query_id, tx.rank AS text_rank, tx.corpus_id AS text_id, im.rank AS image_rank, im.corpus_id AS image_id
FROM tx JOIN im ON im.query_id = tx.query_id""", "J8 J9 J10 U7")
def q_evidence_product(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    tx = neighbours(e, 3, dims("embedding", 1, 32)).select(
        "query_id", F.col("rank").alias("text_rank"), F.col("corpus_id").alias("text_id"))
    # The image side arrives as an external ranked list; keep the
    # current claims only and its top 2 by score
    ext = neighbours(e, 2, dims("embedding", 33, 32)).select("query_id", "corpus_id", "score")
    im = attach_external(ext, tx.select("query_id").distinct(), 2).select(
        "query_id", F.col("rank").alias("image_rank"), F.col("corpus_id").alias("image_id"))
    # Only claims present on the image side; J8: per-claim product
    return tx.join(im, "query_id", "inner")


@register("pair_classifier", None, "R10")
def q_pair_classifier(spark, sf_dir):
    from ..operators.classifier import train_and_predict
    from ..operators.topk import vector_topk
    e = Tables(spark, sf_dir).embeddings
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    c = e.select(F.col("vec_id").alias("corpus_id"), "embedding")
    nn = vector_topk(q, c, 1, q_id="query_id", c_id="corpus_id", exclude_self=True,
                     q_payload={"label": "q_label"})
    pairs = (nn.withColumn("y", (F.col("q_label") % 3).cast("double"))
             .join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
             .join(e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("cv")), "corpus_id"))
    out = train_and_predict(pairs, claim_vec="qv", evidence_vec="cv", label="y")
    return out.select("query_id", "corpus_id", "y", F.col("prediction").cast("int").alias("prediction"))

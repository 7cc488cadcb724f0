"""Keys on training: shuffled_batches, path_classifier.

Binding: a sample is an embedding and its nearest other embedding. Each path reads four
components of either side (text: components 1-4, image: 5-8) and a constant; its
label is the sample's label plus the path's number, by three.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dims
from ..operators.batches import half_bits, round_keys, seeded_batches, sql_feistel
from ..operators.path_models import fit_paths, in_training, predict_paths, weight_rows
from ..session import cut_lineage
from .bindings import neighbours, sql_neighbours
from .registry import Tables, register

SEED, EPOCHS, BATCH = 42, 2, 32
BITS = half_bits(1 << 40)       # one domain for all table sizes


def _sql_epoch(e: int) -> str:
    return f"""(WITH i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
{sql_feistel("idx", BITS, round_keys(SEED, e, BITS), "i")},
p AS (SELECT vec_id, row_number() OVER (ORDER BY l * {1 << BITS} + r) - 1 AS nth FROM r{len(round_keys(SEED, e, BITS))})
SELECT {e} AS epoch, nth // {BATCH} AS batch, nth % {BATCH} AS place, vec_id FROM p)"""


@register("shuffled_batches", "\nUNION ALL\n".join(f"SELECT * FROM {_sql_epoch(e)}" for e in range(EPOCHS)), "T7 S6 W7")
def q_shuffled_batches(spark, sf_dir):
    ids = Tables(spark, sf_dir).embeddings.select("vec_id")
    parts = [seeded_batches(ids, "vec_id", seed=SEED, epoch=e, batch_size=BATCH, n=1 << 40) for e in range(EPOCHS)]
    return reduce(DataFrame.unionByName, parts).select("epoch", "batch", "place", "vec_id")


STEPS, PATHS, CLASSES, WIDTH = 10, 4, 3, 9
#: (first component of the claim's side, of the evidence's side) of each path
SIDES = ((1, 1), (1, 5), (5, 1), (5, 5))

_SQL_X = " UNION ALL ".join(
    f"""SELECT s.query_id AS id, {p} AS path, (s.q_label + {p}) % 3 AS y,
  list_concat(list_concat(a.embedding[{c}:{c + 3}]::DOUBLE[], b.embedding[{e}:{e + 3}]::DOUBLE[]), [1.0]) AS x
  FROM nn s JOIN embeddings a ON a.vec_id = s.query_id JOIN embeddings b ON b.vec_id = s.corpus_id""" for p, (c, e) in enumerate(SIDES))
_SQL_STEPS = ",\n".join(f"""z{i} AS MATERIALIZED (
  SELECT t.id, t.path, t.y, w.cls, sum(w.v * t.v) AS z FROM train t JOIN w{i} w ON w.path = t.path AND w.j = t.j GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT id, path, cls, (y = cls)::INT - exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY id, path) AS miss
  FROM (SELECT *, max(z) OVER (PARTITION BY id, path) AS m FROM z{i})),
w{i + 1} AS MATERIALIZED (
  SELECT w.path, w.cls, w.j, w.v + (g.g - 1.0 * w.v) / (c.c + 1.0) AS v FROM w{i} w
  JOIN (SELECT p.path, p.cls, t.j, sum(p.miss * t.v) AS g FROM p{i} p JOIN train t ON t.id = p.id AND t.path = p.path GROUP BY ALL) g
    ON g.path = w.path AND g.cls = w.cls AND g.j = w.j
  JOIN curve c ON c.path = w.path AND c.j = w.j)""" for i in range(STEPS))


@register("path_classifier", f"""WITH {sql_neighbours(1)},
x AS MATERIALIZED ({_SQL_X}),
xl AS MATERIALIZED (SELECT id, path, y, (id * 7919 + 17) % 100 < 80 AS training, (j - 1)::INT AS j, x[j] AS v FROM x, unnest(range(1, 10)) AS u(j)),
train AS MATERIALIZED (SELECT * FROM xl WHERE training),
curve AS MATERIALIZED (SELECT path, j, sum(abs(v) * s) / 2 AS c
  FROM (SELECT *, sum(abs(v)) OVER (PARTITION BY id, path) AS s FROM train) GROUP BY ALL),
w0 AS MATERIALIZED (SELECT p AS path, c AS cls, j::INT AS j, 0.0::DOUBLE AS v
  FROM unnest(range(0, 4)) AS a(p), unnest(range(0, 3)) AS b(c), unnest(range(0, 9)) AS d(j)),
{_SQL_STEPS},
zt AS (SELECT t.id, t.path, t.y, w.cls, sum(w.v * t.v) AS z FROM xl t JOIN w{STEPS} w ON w.path = t.path AND w.j = t.j
  WHERE NOT training GROUP BY ALL),
pt AS (SELECT id, path, any_value(y) AS y, arg_min(cls, (-z, cls)) AS prediction FROM zt GROUP BY 1, 2)
SELECT 'weight' AS stat, path::INT AS path, cls::INT AS cls, j::INT AS j, round(v, 5) AS value FROM w{STEPS} UNION ALL
SELECT 'confusion', path::INT, y::INT, prediction::INT, count(*)::DOUBLE FROM pt GROUP BY ALL""", "R10 P23 P24 A15")
def q_path_classifier(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings
    nn = neighbours(emb, 1).select("query_id", "corpus_id", "q_label")
    side = [[F.struct(F.lit(p).alias("path"), (F.pmod(F.col("q_label") + p, F.lit(CLASSES))).cast("int").alias("y"),
                      F.concat(dims("qv", c, 4), dims("cv", e, 4), F.array(F.lit(1.0))).alias("x"))] for p, (c, e) in enumerate(SIDES)]
    vec = F.col("embedding").cast("array<double>")
    samples = (nn.join(emb.select(F.col("vec_id").alias("query_id"), vec.alias("qv")), "query_id")
               .join(emb.select(F.col("vec_id").alias("corpus_id"), vec.alias("cv")), "corpus_id")
               .select(F.col("query_id").alias("id"), F.inline(F.array(*[s[0] for s in side]))))
    samples = cut_lineage(samples)
    weights = fit_paths(samples.filter(in_training("id")), paths=PATHS, classes=CLASSES, width=WIDTH, steps=STEPS)
    tested = predict_paths(samples.filter(~in_training("id")), weights, WIDTH)
    confusion = tested.groupBy("path", F.col("y").alias("cls"), F.col("prediction").alias("j")).agg(F.count("*").cast("double").alias("value"))
    return weight_rows(spark, weights).select(F.lit("weight").alias("stat"), "path", "cls", "j", F.round("value", 5).alias("value")) \
        .unionByName(confusion.select(F.lit("confusion").alias("stat"), "path", "cls", "j", "value"))

"""Hand tables from the cited semantics (FIXTURES.md section 3)."""

from itertools import product

from pyspark.sql import Row
from pyspark.sql import functions as F

from verdict.functions.answers import rerank_score2, rerank_score3
from verdict.functions.labels import (collapse_labels, expand_category, fold_paths, parse_answer_label)
from verdict.functions.vectors import argmax
from verdict.operators import prep
from verdict.operators.ireval import hit_at_k, prf_map_at_k
from verdict.operators.metrics import best_so_far, category_accuracy, count_windows, report, weighted_accuracy
from verdict.operators.retrieval import two_stage
from verdict.operators.votes import claim_verdict, majority_vote

S, N, R = "support", "not_enough_information", "refute"


def _resolve(a, b):
    if a == b and a in (S, R):
        return a
    if a in (S, R) and b == N:
        return a
    if b in (S, R) and a == N:
        return b
    return N


def _fold(tt, ti, it, ii):
    r = _resolve(tt, ii)
    return r if r != N else _resolve(ti, it)


def test_fold_cases(spark):
    rows = [(S, R, R, S), (S, R, N, R), (S, S, R, R)]
    df = spark.createDataFrame(rows, "tt string, ti string, it string, ii string")
    got = [r.f for r in df.select(fold_paths("tt", "ti", "it", "ii").alias("f")).collect()]
    assert got == [S, R, N]


def test_fold_exhaustive_81(spark):
    rows = list(product([S, N, R], repeat=4))
    df = spark.createDataFrame(rows, "tt string, ti string, it string, ii string")
    got = {tuple(r[:4]): r.f for r in df.select("*", fold_paths("tt", "ti", "it", "ii").alias("f")).collect()}
    assert len(got) == 81
    for k, v in got.items():
        assert v == _fold(*k), k


def test_fold_missing_is_nei(spark):
    df = spark.createDataFrame([(None, None, None, S)], "tt string, ti string, it string, ii string")
    assert df.select(fold_paths("tt", "ti", "it", "ii").alias("f")).first().f == S


def _verdict(spark, vs):
    ev = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vs)], "q long, pos int, v string")
    return claim_verdict(ev, claim="q", position="pos", verdict="v").first()


def test_claim_vote_tie(spark):
    r = _verdict(spark, [S, S, R, R, N])
    assert r.verdict == N and r.contributing == "5"


def test_claim_vote_nei_majority(spark):
    r = _verdict(spark, [S, N, N, N, N])
    assert r.verdict == S and r.contributing == "1"


def test_majority_tie_on_count(spark):
    df = spark.createDataFrame([(1, "supported", .6), (1, "supported", .7), (1, "refuted", .9),
                                (1, "refuted", .2)], "q long, label string, score double")
    assert majority_vote(df, claim="q", label="label", score="score").first().final_label == "refuted"


def test_majority_full_tie(spark):
    df = spark.createDataFrame([(1, "supported", .9), (1, "refuted", .9)], "q long, label string, score double")
    assert majority_vote(df, claim="q", label="label", score="score").first().final_label == "refuted"


def _pools(spark, gold=None):
    rows = [(1, "train", 1, .9, 1), (1, "test", 2, .9, 1), (1, "test", 3, .8, 2)]
    df = spark.createDataFrame(rows, "query_id long, split string, corpus_id long, s double, pool_rank long")
    return df.withColumn("is_gold", F.col("corpus_id") == (gold if gold is not None else -1))


def test_duplicate_scores(spark):
    r = two_stage(_pools(spark), "s", 2).orderBy("rank").collect()
    assert [(x.split, x.corpus_id) for x in r] == [("train", 1), ("test", 3)]


def test_duplicate_score_is_gold(spark):
    r = two_stage(_pools(spark, 2), "s", 2, keep=F.col("is_gold")).orderBy("rank").collect()
    assert [(x.split, x.corpus_id) for x in r] == [("train", 1), ("test", 2)]


def _prf(spark, ranked, gold, ks):
    r = spark.createDataFrame(ranked, "query_id long, rank long, is_rel boolean")
    g = spark.createDataFrame(gold, "query_id long, n_gold long")
    return {x.k: x for x in prf_map_at_k(r, g, ks=ks).collect()}


def test_short_result_list(spark):
    m = _prf(spark, [(1, 1, True)], [(1, 3)], [5])[5]
    assert m.precision == 1.0 and abs(m.recall - 1 / 3) < 1e-6 and abs(m.map - 1 / 3) < 1e-6


def test_average_precision(spark):
    ranked = [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, False), (1, 5, False)]
    assert _prf(spark, ranked, [(1, 3)], [5])[5].map == 0.555556


def test_query_without_hits(spark):
    m = _prf(spark, [(1, 1, True)], [(1, 1), (2, 2)], [1])[1]
    assert m.precision == 0.5 and m.recall == 0.5 and m.map == 0.5
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    ranked = spark.createDataFrame([(1, 1, True)], "query_id long, rank long, is_gold boolean")
    assert hit_at_k(ranked, q, ks=[1]).first().hit_rate == 0.5


def test_unknown_category_and_label_vector(spark):
    df = spark.createDataFrame([("Other",)], "c string")
    assert df.select(expand_category(F.col("c")).alias("a")).first().a == [1, 1, 1, 1]
    df = spark.createDataFrame([([2, 1, 1, 1],)], "l array<int>")
    assert df.select(collapse_labels(F.col("l")).alias("c")).first().c == "Insufficient_Text"


def test_labels_round_trip(spark):
    from verdict.schemas import CATEGORIES
    df = spark.createDataFrame([(c,) for c in CATEGORIES], "c string")
    got = df.select("c", collapse_labels(expand_category(F.col("c"))).alias("back")).collect()
    assert all(r.c == r.back for r in got)


def test_caption_enrichment(spark):
    df = spark.createDataFrame([("a", ""), (None, "c")], "t string, c string")
    r = df.select(prep.enrich_batch(F.col("t"), F.col("c")).alias("b"),
                  prep.enrich_online(F.col("t"), F.col("c")).alias("o")).collect()
    assert [x.b for x in r] == ["a. ", "nan. c"] and [x.o for x in r] == ["a", None]


def test_answer_parse_order(spark):
    df = spark.createDataFrame([("Support or refute",), ("It is false",), ("maybe",)], "t string")
    assert [r.l for r in df.select(parse_answer_label(F.col("t")).alias("l")).collect()] == [0, 2, 1]


def test_marker_missing(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "x ### Answer:  Yes \n")], "id long, t string")
    parsed, rej = prep.parse_answers(df, "t")
    got = {r.id: r.answer for r in parsed.collect()}
    assert got == {1: "yes", 2: "yes"} and [r.id for r in rej.collect()] == [1]


def test_rerank_two_and_three_way(spark):
    df = spark.createDataFrame([("yes", .8), ("no", .8), ("yes", 0.0), ("other", .3)], "a string, s double")
    two = [round(r.v, 9) for r in df.select(rerank_score2(F.col("a"), F.col("s")).alias("v")).collect()]
    assert two == [0.8, 0.000002, 1.0, 0.000007]
    three = [round(r.v, 9) for r in df.select(rerank_score3(F.col("a"), F.col("s")).alias("v")).collect()]
    assert three[:2] == [0.8, 0.000002] and three[3] == 0.0


def test_weighted_accuracy(spark):
    df = spark.createDataFrame([("Refute", "Support_Text"), ("Support_Text", "Support_Text")], "y string, p string")
    assert weighted_accuracy(df, "y", "p", F.col("y") == "Refute", 4.0).first()[0] == 0.2


def test_absent_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    spine = spark.createDataFrame([("a",), ("b",), ("z",)], "cls string")
    rep = {(r.metric, r.cls): r.value for r in report(df, "y", "p", classes=spine).collect()}
    assert rep[("precision", "z")] == 0 and rep[("recall", "z")] == 0 and rep[("f1", "z")] == 0
    acc = {r.cls: r.accuracy for r in category_accuracy(df, "y", "p", spine).collect()}
    assert acc["z"] == 0.0 and acc["a"] == 1.0 and acc["b"] == 0.0


def test_micro_f1_equals_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (3, 3)], "y int, p int")
    rep = {(r.metric, r.cls): r.value for r in report(df, "y", "p").collect()}
    assert rep[("micro_f1", "all")] == rep[("accuracy", "all")] == 0.6


def test_count_window(spark):
    df = spark.createDataFrame([(0, s) for s in range(8)], "epoch int, step long")
    got = sorted((r.win_id, r.step) for r in count_windows(df, epoch="epoch", step="step", length=3).collect())
    wins = {}
    for w, s in got:
        wins.setdefault(w, []).append(s)
    assert list(wins.values()) == [[0], [1, 2, 3], [4, 5, 6]]


def test_best_so_far(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([.5, .5, .7, .6])], "epoch int, m double")
    got = [r.epoch for r in best_so_far(df, order="epoch", value="m").collect() if r.is_new_best]
    assert sorted(got) == [0, 2]


def test_argmax_tie(spark):
    df = spark.createDataFrame([([.4, .4, .2],)], "a array<double>")
    assert df.select(argmax("a").alias("i")).first().i == 0


def test_path_decode(spark):
    df = spark.createDataFrame([("train_12",), ("test_3",), ("dev_4",)], "k string")
    sp, i = prep.decode_split_key(F.col("k"))
    got = [(r.s, int(r.i)) for r in df.select(sp.alias("s"), i.alias("i")).filter("s <> ''").collect()]
    assert got == [("train", 12), ("test", 3)]


def test_image_name(spark):
    df = spark.createDataFrame([("12_evidence.jpg",), ("12_claim.jpg",), ("1_evidence_x.jpg",)], "n string")
    assert [r.n for r in df.filter(prep.is_evidence_image(F.col("n"))).collect()] == ["12_evidence.jpg"]


def test_code_points(spark):
    df = spark.createDataFrame([("héllo😀",)], "t string")
    assert df.select(F.length("t")).first()[0] == 6


def test_dense_index(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    got = sorted((r.idx, r.k) for r in prep.dense_index(df, "k").collect())
    assert [i for i, _ in got] == list(range(len(got))) and [k for _, k in got] == list(range(0, 1000, 3))

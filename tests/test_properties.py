"""Properties and brute-force agreement of the distributed operators,
including multi-block grids (small block sizes force several cells)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.functions.answers import generated_token_prob, group_answer
from verdict.operators import langid
from verdict.operators.ensemble import grid_search
from verdict.operators.lexical import lexical_topk
from verdict.operators.topk import round_half_away, vector_topk


def _vectors(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).round(2)  # coarse values: many exact ties
    rows = [(i, [float(x) for x in m[i]]) for i in range(n)]
    return m, spark.createDataFrame(rows, "id long, embedding array<float>")


def _brute(Q, C, qids, cids, k, dedup, exclude_self):
    Qf, Cf = Q.astype(np.float32).astype(np.float64), C.astype(np.float32).astype(np.float64)
    Qn = Qf / np.maximum(np.linalg.norm(Qf, axis=1), 1e-6)[:, None]
    Cn = Cf / np.maximum(np.linalg.norm(Cf, axis=1), 1e-6)[:, None]
    S = round_half_away(Qn @ Cn.T, 6)
    out = {}
    for i, q in enumerate(qids):
        cand = sorted(((-S[i, j], c) for j, c in enumerate(cids) if not (exclude_self and c == q)))
        seen, res = set(), []
        for s, c in cand:
            if dedup and s in seen:
                continue
            seen.add(s)
            res.append((c, -s))
            if len(res) == k:
                break
        out[q] = res
    return out


@pytest.mark.parametrize("dedup", [False, True])
@pytest.mark.parametrize("blocks", [(4096, 16384), (7, 11)])
def test_topk_matches_brute_force(spark, dedup, blocks):
    M, df = _vectors(spark, 60, 5, 1)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    c = df.select(F.col("id").alias("corpus_id"), "embedding")
    got = vector_topk(q, c, 4, q_id="query_id", c_id="corpus_id", exclude_self=True, dedup_scores=dedup,
                      q_block_rows=blocks[0], c_block_rows=blocks[1]).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append((r.corpus_id, r.score))
    exp = _brute(M, M, list(range(60)), list(range(60)), 4, dedup, True)
    for qid in range(60):
        assert [c for c, _ in res[qid]] == [c for c, _ in exp[qid]], qid
        if dedup:
            scores = [s for _, s in res[qid]]
            assert len(scores) == len(set(scores))


def test_lexical_matches_brute_force(spark):
    claims = [(1, "red apple pie"), (2, "blue sky, apple!"), (3, "nothing shared zzz")]
    docs = [(i, t) for i, t in enumerate(["apple pie recipe", "red red wine", "sky is blue", "apple apple",
                                           "pie in the sky", "", "Red APPLE"])]
    c = spark.createDataFrame(claims, "cid long, text string")
    d = spark.createDataFrame(docs, "did long, text string")
    got = lexical_topk(c, d, 3, claim_id="cid", claim_text="text", doc_id="did", doc_text="text",
                       q_block_rows=2, d_block_rows=2).collect()
    toks = {i: set(filter(None, __import__("re").split(r"[^\w]+", t.lower()))) for i, t in docs}
    df = {}
    for s in toks.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    exp = {}
    for cid, text in claims:
        ct = set(filter(None, __import__("re").split(r"[^\w]+", text.lower())))
        sc = [(-round(sum(math.log(len(docs) / df[t]) for t in ct & toks[i]), 6), i)
              for i in toks if ct & toks[i]]
        exp[cid] = [i for _, i in sorted(sc)[:3]]
    res = {}
    for r in sorted(got, key=lambda r: (r.cid, r.rank)):
        res.setdefault(r.cid, []).append(r.did)
    assert res.get(1) == exp[1] and res.get(2) == exp[2] and 3 not in res


def test_grid_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n, k = 40, 5
    P = [rng.dirichlet(np.ones(k), size=n) for _ in range(3)]
    y = rng.integers(0, k, size=n)
    rows = [(int(y[i]), *[[float(x) for x in P[m][i]] for m in range(3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "y int, m1 array<double>, m2 array<double>, m3 array<double>")
    W, Pw = [0, 0.5, 1], [0.5, 1]
    got = grid_search(df, weights=W, powers=Pw, tasks=3).first()
    assert grid_search(df, weights=W, powers=Pw, tasks=9, fan=2).first() == got   # counts summed over a tree
    assert grid_search(df.limit(0), weights=W, powers=Pw, tasks=3).first().best_f1 is None
    best, arg = 0, None
    for w1 in W:
        for w2 in W:
            for w3 in W:
                for p1 in Pw:
                    for p2 in Pw:
                        for p3 in Pw:
                            s = w1 * P[0] ** p1 + w2 * P[1] ** p2 + w3 * P[2] ** p3
                            pred = round_half_away(s, 9).argmax(axis=1)
                            f1 = 0.0
                            for c in range(k):
                                tp = int(((pred == c) & (y == c)).sum())
                                sup, npr = int((y == c).sum()), int((pred == c).sum())
                                f1 += sup * (2 * tp / (sup + npr) if sup + npr else 0)
                            f1 = round(f1 / n, 5)
                            if f1 > best:
                                best, arg = f1, (w1, w2, w3, p1, p2, p3)
    assert got.best_f1 == best
    assert (got.w1, got.w2, got.w3, got.p1, got.p2, got.p3) == arg


def test_hit_at_k_monotone(spark):
    from tests.conftest import SF_SMALL
    from verdict.plans.registry import all_queries
    rows = sorted(all_queries()["hit_at_k"].build(spark, SF_SMALL).collect())
    rates = [r.hit_rate for r in rows]
    assert rates == sorted(rates)


def test_confusion_sums_to_n(spark):
    from tests.conftest import SF_SMALL
    from verdict.plans.registry import all_queries
    cm = all_queries()["confusion_matrix"].build(spark, SF_SMALL)
    assert cm.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()


def test_topk_half_precision_option(spark):
    M, df = _vectors(spark, 40, 6, 7)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    c = df.select(F.col("id").alias("corpus_id"), "embedding")
    got = vector_topk(q, c, 3, q_id="query_id", c_id="corpus_id", exclude_self=True,
                      quantize="float16").collect()
    H = M.astype(np.float32).astype(np.float16).astype(np.float64)
    exp = _brute(H, H, list(range(40)), list(range(40)), 3, False, True)
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.corpus_id)
    assert all(res[i] == [c for c, _ in exp[i]] for i in range(40))


def test_path_rewrite_rules(spark):
    import pytest as _pt
    from verdict.operators import prep
    df = spark.createDataFrame([("train_12_evidence.jpg",), ("test_3_evidence.jpg",)], "n string")
    got = sorted(r.p for r in df.select(prep.canonical_path(F.col("n")).alias("p")).collect())
    assert got == ["images/test/3_evidence.jpg", "images/train/12_evidence.jpg"]
    bad = spark.createDataFrame([("dev_4_evidence.jpg",)], "n string")
    with _pt.raises(Exception, match="no split prefix in the file name"):
        bad.select(prep.canonical_path(F.col("n"))).collect()
    raw = spark.createDataFrame([("a" + chr(92) + "b" + chr(92) + "x.jpg", 1), ("a/b/x.jpg", 2)], "p string, v long")
    norm = raw.select(prep.normalise_separators(F.col("p")).alias("k"), "v")
    last = norm.groupBy("k").agg(F.max_by("v", "v").alias("v")).collect()
    assert [(r.k, r.v) for r in last] == [("a/b/x.jpg", 2)]


def test_topk_empty_sides(spark):
    M, df = _vectors(spark, 5, 3, 11)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    empty = spark.createDataFrame([], "corpus_id long, embedding array<float>")
    assert vector_topk(q, empty, 3, q_id="query_id", c_id="corpus_id").count() == 0
    c = df.select(F.col("id").alias("corpus_id"), "embedding")
    noq = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert vector_topk(noq, c, 3, q_id="query_id", c_id="corpus_id").count() == 0


def test_topk_leaves_out_null_vectors_and_rejects_other_widths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q, c = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "corpus_id")
    got = vector_topk(q, c, 3, q_id="query_id", c_id="corpus_id", exclude_self=True).collect()
    assert sorted((r.query_id, r.corpus_id) for r in got) == [(0, 1), (1, 0)]
    odd = spark.createDataFrame([(4, [1.0, 0.0, 0.0])], "corpus_id long, embedding array<float>")
    with pytest.raises(Exception, match="vectors of different widths"):
        vector_topk(q, c.unionByName(odd), 3, q_id="query_id", c_id="corpus_id",
                    q_block_rows=100, c_block_rows=100).collect()


def test_answer_scores_take_the_whole_vocabulary(spark):
    width = 32_000
    df = spark.range(20).select("id", F.transform(F.sequence(F.lit(1), F.lit(width)),
                                                  lambda i: (F.pmod(i * 7919 + F.col("id"), 1000) / 100.0)).alias("z"))
    got = df.select("id", generated_token_prob(F.col("z")).alias("g"),
                    group_answer(F.col("z"), {"yes": [1, 2], "no": [3]}, whole=True, other="NEI").alias("a")).collect()
    for r in got:
        z = np.array([(i * 7919 + r.id) % 1000 / 100.0 for i in range(1, width + 1)])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.g.token == int(z.argmax()) and math.isclose(r.g.prob, p.max(), rel_tol=1e-9)
        best = max({"yes": p[0] + p[1], "no": p[2], "NEI": 1 - p[0] - p[1] - p[2]}.items(), key=lambda x: x[1])
        assert r.a.label == best[0] and math.isclose(r.a.score, best[1], rel_tol=1e-9)


def test_blank_text_has_no_language(spark):
    d = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et      le chien", "fr"), (3, " \n\t    ", "fr")],
                              "doc_id long, text string, lang string")
    model, totals = langid.train(d, id_col="doc_id", text_col="text", lang_col="lang")
    got = {r.doc_id: r.lang_pred for r in langid.detect(d, model, totals, id_col="doc_id", text_col="text").collect()}
    assert got == {1: "en", 2: "fr", 3: "unknown"}

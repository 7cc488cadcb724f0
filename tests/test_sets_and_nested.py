"""Bitmap id sets and nested claim documents against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from verdict.operators.idsets import container, id_sets, in_sets, intersect_sets, merge_sets, positions, set_sizes
from verdict.operators.ireval import judged_metrics, relevant_sets
from verdict.operators.nested import claim_documents, placed


def members():
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([rng.randrange(40), rng.randrange(-10 ** 6, 10 ** 6), 2 ** 40 + rng.randrange(70_000)])) for _ in range(3000)]
    rows += [("hot", i) for i in range(0, 200_000, 2)] + [("hot", 4)] * 500 + [("none", None), (None, 5)]
    return rows


def plain(rows):
    out = {}
    for k, i in rows:
        if i is not None:
            out.setdefault(k, set()).add(i)
    return out


def test_containers_take_the_shorter_form():
    for n in (0, 1, 2047, 2048, 32768):
        at = np.sort(np.random.default_rng(n).permutation(32768)[:n])
        c = container(at)
        assert positions(c).tolist() == at.tolist()
        assert len(c) == (2 * n if n < 2048 else 4096)


def test_sets_against_plain_sets(spark):
    rows = members()
    df = spark.createDataFrame(rows, "k string, id long")
    sets, want = id_sets(df, ["k"], "id"), plain(rows)
    assert {r.k: r.n_ids for r in set_sizes(sets, ["k"]).collect()} == {k: len(v) for k, v in want.items()}
    other = [("hot", i) for i in range(0, 3_000, 3)] + [("a", 7), ("new", 1)]
    more = id_sets(spark.createDataFrame(other, "k string, id long"), ["k"], "id")
    joint = plain(rows + other)
    assert {r.k: r.n_ids for r in set_sizes(merge_sets(sets, more, ["k"]), ["k"]).collect()} == {k: len(v) for k, v in joint.items()}
    cut = {k: len(want[k] & v) for k, v in plain(other).items() if k in want and want[k] & v}
    assert {r.k: r.n_ids for r in set_sizes(intersect_sets(sets, more, ["k"]), ["k"]).collect()} == cut
    asked = [(k, i, "x") for k in ("a", "b", "hot", "no set") for i in list(range(-5, 50)) + [2 ** 40 + j for j in range(60)] + [199_998, 199_999, 10 ** 7]]
    asked += [("a", None, "x"), ("hot", 2, "y"), ("hot", 2, "y")]
    got = in_sets(spark.createDataFrame(asked, "k string, id long, ids string"), sets, ["k"], "id", "there").collect()
    assert sorted((r.k, r.id is None, r.id or 0, r.ids, r.there) for r in got) == \
        sorted((k, i is None, i or 0, x, i in want.get(k, ())) for k, i, x in asked)


def test_sets_of_nothing(spark):
    empty = id_sets(spark.createDataFrame([], "k string, id long"), ["k"], "id")
    assert empty.count() == 0
    r = in_sets(spark.createDataFrame([("a", 1)], "k string, id long"), empty, ["k"], "id", "there").first()
    assert not r.there


def test_judged_metrics_by_hand(spark):
    judged = spark.createDataFrame([(1, 10, True), (1, 11, True), (1, 12, False), (1, 100, True), (2, 10, False)],
                                   "query_id long, doc_id long, positive boolean")
    queries = spark.createDataFrame([(100, 1), (101, 1), (102, 2)], "query_id long, claim_id long")
    ranked = spark.createDataFrame([(100, 12, 1), (100, 10, 2), (101, 11, 1), (101, 100, 2), (102, 10, 1)],
                                   "query_id long, corpus_id long, rank long")
    r = {x.k: x for x in judged_metrics(ranked, queries, relevant_sets(judged), ks=[1, 2]).collect()}
    # 100: two relevant without itself, a hit at 2; 101: three relevant, hits at 1 and 2; 102: none
    assert (r[1].precision, r[1].recall) == (round(1 / 3, 6), round((1 / 3) / 3, 6))
    assert (r[2].precision, r[2].recall) == (0.5, round((1 / 2 + 2 / 3) / 3, 6))
    assert r[2].map == round(((1 / 2) / 2 + 1) / 3, 6)


def evidence():
    rng = random.Random(9)
    rows = [(rng.randrange(20), rng.choice([None, 1, 2, 3]), i, rng.choice(["text", "image"]), "é" * rng.randint(0, 30)) for i in range(800)]
    rows += [(7, rng.randrange(5), 1000 + i, "text", f"hub {i} " * 3) for i in range(4000)]       # most rows are of one claim
    return rows + [(7, 2, 1000, "text", "same")] * 3 + [(None, 1, 1, "text", "x"), (30, 1, 1, "text", None), (31, 1, 1, "text", "")]


def test_nested_claims_against_plain_assembly(spark):
    rows, size = evidence(), 500
    df = spark.createDataFrame([(*r, 3) for r in rows], "claim_id long, doc_id long, place long, kind string, content string, segment long")
    got = {(r.claim_id, r.segment): [(d.doc_id, list(d.texts), list(d.images)) for d in r.documents]
           for r in claim_documents(df.drop("segment"), segment_bytes=size).collect()}
    want, at = {}, {}
    for c, d, p, k, x in sorted((r for r in rows if r[0] is not None and r[4]), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3], r[4])):
        docs = want.setdefault((c, at.get(c, 0) // size), [])
        if not docs or docs[-1][0] != d:
            docs.append((d, [], []))
        docs[-1][1 if k == "text" else 2].append(x)
        at[c] = at.get(c, 0) + len(x.encode())
    assert got == want and len([k for k in want if k[0] == 7]) > 100
    assert claim_documents(df.filter("false").drop("segment")).count() == 0


def test_a_hub_claim_is_spread_over_tasks(spark):
    df = spark.createDataFrame(evidence(), "claim_id long, doc_id long, place long, kind string, content string").filter("content <> ''")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("claim_id", "doc_id", "place", "kind", "content").withColumn("part", F.spark_partition_id())
        assert ranges.filter("claim_id = 7").select("part").distinct().count() > 3
        most = placed(df, 500).groupBy("claim_id", "segment").agg(F.sum(F.octet_length("content")).alias("n")).agg(F.max("n")).first()[0]
        assert most <= 500 + 60
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

"""Write-then-read round trips for the sources and sinks."""

import os

import pytest

from pyspark.sql import functions as F

from verdict.sources import readers, sinks


def test_tsv_round_trip(spark, scratch):
    path = os.path.join(scratch, "claims.tsv")
    with open(path, "w") as f:
        f.write("Id\tClaim\tClaim_image\tEvidence\tEvidence_image\tCategory\tOcr1\tOcr2\n")
        f.write('1\t"a\ttab"\thttp://x/1.jpg\t"line1\nline2"\t\tRefute\t"say ""hi"""\t\n')
        f.write("2\tplain\t\t\t\tSupport_Text\t\t\n")
    df = readers.read_claims_tsv(spark, path).orderBy("id").collect()
    assert [r.id for r in df] == [1, 2]
    assert df[0].claim == "a\ttab" and df[0].evidence == "line1\nline2" and df[0].claim_ocr == 'say "hi"'
    assert df[0].evidence_image is None and df[1].category == "Support_Text"


def test_vectors_and_empty(spark, scratch):
    path = os.path.join(scratch, "vec")
    df = spark.createDataFrame([("train", 1, [0.5, 0.25])], "split string, id long, embedding array<float>")
    sinks.write_table(df, path)
    sinks.write_table(df.withColumn("id", F.lit(2).cast("long")), path, mode="append")
    back = readers.read_vectors(spark, path).orderBy("id").collect()
    assert [r.id for r in back] == [1, 2] and back[0].embedding == [0.5, 0.25]
    os.makedirs(os.path.join(scratch, "empty"))
    assert readers.read_vectors(spark, os.path.join(scratch, "empty"), "image").count() == 0


def test_append_history(spark, scratch):
    from verdict.operators.history import latest_per_model
    path = os.path.join(scratch, "hist")
    for v in (0.5, 0.7):
        sinks.append_history(spark.createDataFrame([("m", "f1", v)], "model string, metric string, value double"),
                             path)
    h = spark.read.parquet(path)
    assert h.count() == 2
    assert latest_per_model(h, model="model", ts="run_ts").first().value == 0.7


def test_image_listing_prunes_content(spark, scratch):
    d = os.path.join(scratch, "imgs")
    os.makedirs(d)
    for n in ("1_claim.jpg", "1_evidence.jpg", "notes.txt"):
        open(os.path.join(d, n), "wb").write(b"x")
    df = readers.list_images(spark, d)
    assert sorted(os.path.basename(r.path) for r in df.collect()) == ["1_claim.jpg", "1_evidence.jpg"]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1][:60]


def test_qrels_passages_candidates_probs(spark, scratch):
    q = os.path.join(scratch, "qrels.csv")
    with open(q, "w") as f:
        f.write("TOPIC,DOCUMENT#,RELEVANCY,evidence_relevant\n1,a,1,0\n1,b,0,1\n2,c,2,1\n")
    pos = {(r.query_id, r.doc_id) for r in readers.read_qrels(spark, q).filter("positive").collect()}
    assert pos == {(1, "a")}
    pos = {(r.query_id, r.doc_id) for r in readers.read_qrels(spark, q, "evidence_relevant")
           .filter("positive").collect()}
    assert pos == {(1, "b"), (2, "c")}
    p = os.path.join(scratch, "passages.csv")
    with open(p, "w") as f:
        f.write('claim_id,relevant_document_id,paragraph_id,paragraph\n1,2,3," text\n"\n1,2,1,b\n0,5,5,c\n')
    rows = readers.read_passages(spark, p).collect()
    assert sorted((r.key, r.text) for r in rows) == [("0-5-5", "c"), ("1-2-1", "b"), ("1-2-3", "text")]
    c = os.path.join(scratch, "cand")
    spark.createDataFrame([(1, "x.jpg", 0.5)], "query_id long, corpus_id string, score double").write.parquet(c)
    assert readers.read_candidates(spark, c, "/imgs").first().corpus_path == "/imgs/x.jpg"
    paths = []
    for i in range(3):
        mp = os.path.join(scratch, f"m{i}.csv")
        with open(mp, "w") as f:
            f.write("id,p0,p1,p2,p3,p4\n2,0.1,0.2,0.3,0.2,0.2\n1,0.5,0.1,0.1,0.1,0.2\n")
        paths.append(mp)
    probs = {r.id: r for r in readers.read_model_probs(spark, paths).collect()}
    assert probs[1].m3[0] == 0.5 and probs[2].m1[2] == 0.3
    for odd in ("id,p0,p1,p2,p3,p4\n1,0.5,0.1,0.1,0.1,0.2\n", "id,p0,p1,p2,p3,p4\n1,0,0,0,0,1\n2,0,0,0,0,1\n2,0,0,0,1,0\n"):
        with open(paths[1], "w") as f:   # an id is missing, or there twice
            f.write(odd)
        with pytest.raises(Exception, match="rows of id 2"):
            readers.read_model_probs(spark, paths).collect()


def test_last_processed_index(spark):
    from verdict.streaming.incremental import last_processed_index
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, None)], "idx long, caption string")
    assert last_processed_index(df).first()[0] == 2
    assert last_processed_index(df.filter("caption IS NULL")).first()[0] == -1


def test_claims_truth_and_judged(spark, scratch):
    p = os.path.join(scratch, "corpus2.csv")
    with open(p, "w") as f:
        f.write('claim_id,Claim,cleaned_truthfulness\n1,"  first ",supported\n2,b,refuted\n1,"second\nline ",NEI\n')
    c = readers.read_claims_truth(spark, p).coalesce(1)
    judged = spark.createDataFrame([(1,), (3,)], "claim_id long")
    rows = readers.judged_claims(c, judged).collect()
    assert len(rows) == 1 and rows[0].Claim == "second\nline" and rows[0].cleaned_truthfulness == "NEI"


def test_samples_scan(spark, scratch):
    p = os.path.join(scratch, "samples")
    spark.createDataFrame([(0, "c", "d", None, None, [0, 1, 1, 1])],
                          readers.SAMPLES).write.parquet(p)
    df = readers.read_samples(spark, p, ["idx", "labels"])
    assert df.columns == ["idx", "labels"] and df.first().labels == [0, 1, 1, 1]


def test_stats_json_and_binary_claims_and_positives(spark, scratch):
    from verdict.operators.ireval import qrels_summary, queries_with_positives
    from verdict.operators.votes import binary_claims
    st = spark.createDataFrame([("ALL", 3, 2)], "category string, total_claim long, successful_claim long")
    out = os.path.join(scratch, "stats")
    sinks.write_stats_json(st, out)
    assert spark.read.json(out).first().total_claim == 3
    c = spark.createDataFrame([(1, "supported"), (2, "NEI"), (3, None)], "claim_id long, v_label string")
    assert [r.claim_id for r in binary_claims(c).collect()] == [1]
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    qr = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (1, "z", 0), (2, "w", 0)],
                               "query_id long, doc string, RELEVANCY int")
    pos = qrels_summary(qr, q_id="query_id", doc_id="doc", level="RELEVANCY")
    got = [(r.query_id, r.n_relevant, r.min_relevant) for r in queries_with_positives(q, pos).collect()]
    assert got == [(1, 2, "x")]

"""R1 resume semantics: only missing keys are processed; an empty caption
counts as done; a second run processes nothing."""

import os

import pandas as pd

from verdict.streaming.incremental import enrich_pending, start_enrichment_stream


def captioner(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": pdf["id"], "caption": ["" if i == 4 else f"cap{i}" for i in pdf["id"]]})


def test_resume(spark, scratch):
    out = os.path.join(scratch, "out")
    spark.createDataFrame([(1, "", "x"), (3, "c", "x. c")], "id long, caption string, enriched string") \
        .write.parquet(out)
    claims = spark.createDataFrame([(i, f"t{i}", f"{i}.jpg") for i in range(1, 5)], "id long, text string, image string")
    assert enrich_pending(claims, out, captioner) == 2
    got = {r.id: r.enriched for r in spark.read.parquet(out).collect()}
    assert got[2] == "t2. cap2" and got[4] == "t4"
    assert enrich_pending(claims, out, captioner) == 0


def test_stream_resume(spark, scratch):
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    schema = "id long, text string, image string"
    spark.createDataFrame([(1, "a", "1.jpg"), (2, "b", "2.jpg")], schema).write.parquet(src)
    from pyspark.sql import types as T
    st = T._parse_datatype_string(schema)
    q = start_enrichment_stream(spark, src, out, captioner, st, name="t1")
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3, "c", "3.jpg")], schema).write.mode("append").parquet(src)
    q = start_enrichment_stream(spark, src, out, captioner, st, name="t1")
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_repeated_ids_are_one_claim(spark, scratch):
    out = os.path.join(scratch, "out")
    claims = spark.createDataFrame([(1, "b", "1.jpg"), (1, "a", "1.jpg"), (None, "x", "x.jpg"), (4, "d", "4.jpg")],
                                   "id long, text string, image string")
    assert enrich_pending(claims, out, captioner) == 2
    assert {r.id: r.enriched for r in spark.read.parquet(out).collect()} == {1: "a. cap1", 4: "d"}


def test_stream_checkpoint_is_found_by_the_next_application(spark, scratch):
    from pyspark.sql import types as T
    src, out, folder = (os.path.join(scratch, x) for x in ("src", "out", "ckpt"))
    schema = "id long, text string, image string"
    spark.createDataFrame([(1, "a", "1.jpg")], schema).write.parquet(src)
    for _ in range(2):     # Spark gives every application a folder of its own under the named one
        spark.sparkContext.setCheckpointDir(folder)
        q = start_enrichment_stream(spark, src, out, captioner, T._parse_datatype_string(schema), name="t2")
        q.awaitTermination()
    assert os.path.isdir(os.path.join(folder, "t2-stream", "commits"))
    assert [x for x in os.listdir(os.path.join(folder, "t2-stream", "commits")) if not x.startswith(".")] == ["0"]


def test_failing_rows_are_null_and_stand_alone(spark):
    from verdict.operators.prep import batch_score

    def scorer(pdf):
        if pdf["text"].isna().any() or (pdf["text"] == "bad").any():
            raise RuntimeError("model failed")
        return pdf.assign(n=pdf["text"].str.len())[["id", "n"]]
    rows = [(i, "bad" if i in (3, 50, 51) else None if i == 70 else "x" * i) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.id: r.n for r in batch_score(df, scorer, "id long, n long").collect()}
    assert got == {i: None if t in ("bad", None) else i for i, t in rows}
    assert batch_score(df.filter("false"), scorer, "id long, n long").count() == 0

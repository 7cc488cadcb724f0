"""Inputs that once ended a run: long runs of one character, numbers out of range,
odd column names; and the stages of the pipeline on small tables."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdict.llm.chat import _written, canonical
from verdict.llm.packing import token_pieces
from verdict.llm.substring import remove_repeats
from verdict.llm.words import Words, _powers


def pieces_of(spark, texts):
    import public_tokenizers as p
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return token_pieces(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, end_id=2, capacity=1024,
                        special={"<|endoftext|>": 50256}, whole=p.path("byte_bpe_50k.json"))


def test_pieces_against_the_vocabularys_own_tokenizer(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    texts = [None, "", " ", "one", "one", "word " * 3000, " " * 1_000_000, "\n" * 1_000_000, "a" * 300_000, "x" + "\t " * 400_000 + "y",
             "it's 12345 <|endoftext|> \r\n\r\n  é 日本語 \U0001F600‍  end", "z" * 1023, "tok " * 1022 + "tok"]
    got = {}
    for r in pieces_of(spark, texts).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        rows = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        at, out = 0, []
        for r in rows:
            assert r.start == at and r.length == len(r.ids) // 4
            assert r.length == 1024 or r.piece == 0 and 0 < r.length <= 1024
            out += [int.from_bytes(r.ids[j:j + 4], "little") for j in range(0, len(r.ids), 4)]
            at += r.length
        assert out == ids
    assert pieces_of(spark, []).count() == 0


@pytest.mark.parametrize("text,wrong", [
    ('{"text":"a","lines":1e999}', "$: not JSON"), ('{"text":"a","lines":-1e999}', "$: not JSON"), ('{"text":"a","lines":NaN}', "$: not JSON"),
    ('{"text":"a","lines":Infinity}', "$: not JSON"), ('{"text":"a","lines":' + "9" * 5000 + "}", "$: not JSON"),
    ("[" * 100_000 + "]" * 100_000, "$: not JSON"), ('{"text":"a","lines":1.0}', None), ('{"text":"a","lines":1.5}', "$.lines: type"), ("", "$: not JSON")])
def test_arguments_out_of_range(text, wrong):
    schema = {"type": "object", "properties": {"text": {"type": "string"}, "lines": {"type": "integer"}}}
    names = ["kind", "role", "text", "call_id", "name"]
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in ("call", "assistant", text, "c", "t")], names)
    out = list(_written({"t": schema})([batch]))[0].to_pylist()[0]
    assert out["problem"] == wrong
    json.loads(out["message"])


def test_canonical_numbers():
    known = {1e-5: "0.00001", 1.25e-6: "0.00000125", -3e-5: "-0.00003", 1e-7: "1e-7", 1.5e-9: "1.5e-9", 0.0001: "0.0001", 1e21: "1e+21",
             1e20: "100000000000000000000", 5.0: "5", 0.1: "0.1"}
    assert {x: canonical(x) for x in known} == known


def test_columns_with_odd_names_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5, "a", 2), (2, text, 6, "b", 3)], "doc_id long, text string, `x.y` int, `a b` string, key int")
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert (rows[1]["x.y"], rows[2]["a b"], rows[2].key, rows[1].n_removed, rows[2].n_removed) == (5, "b", 3, 0, 30)


def test_cached_arrays_stay_in_their_process():
    from pyspark import cloudpickle
    Words(pa.array(["a b c"])).hashes()
    assert len(_powers) and len(cloudpickle.dumps(Words)) < 100_000


def test_pipeline_on_odd_documents(spark, tmp_path):
    import corpus_pipeline
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long, "en", "s", 10), (2, long, "en", "s", 10), (3, None, "en", "s", 0), (4, "", None, None, 0), (5, " " * 300_000, "en", "s", 0),
            (6, "alone " + " ".join(f"other{i}" for i in range(50)), "de", "s", 5), (None, "no id", "en", "s", 5), (7, "twice", "en", "s", 5), (7, "twice", "en", "s", 5)]
    labels = [(i, i % 2, int(i in (50, 51))) for i in range(1, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert 1 in kept and 2 not in kept and {3, 5, 6, 7, None} <= kept
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").filter(F.lit(False))
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

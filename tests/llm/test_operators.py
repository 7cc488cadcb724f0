"""Each operator against a brute-force version on small tables with nulls,
empty texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.llm import unigram as u
from verdict.llm.chat import CALLS, format_chat
from verdict.llm.near_dedup import near_duplicates
from verdict.llm.packing import _rounded, pack, plan_sequences
from verdict.llm.pivot_dedup import near_duplicate_vectors
from verdict.llm.queries import URL_RULES
from verdict.llm.store import new_path
from verdict.llm.substring import remove_repeats
from verdict.llm.toxicity import score_toxicity
from verdict.llm.unigram import decode, encode
from verdict.llm.url_filter import judge_urls
from verdict.llm.va_file import top_k
from verdict.llm.warc import MAGIC, read_archives, write_archives

DOCS = "doc_id long, text string, spans string, uid string, n_words long"


def model_path():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "s", "u", 1) for i, t in enumerate(texts)], DOCS)


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    out = list(base)
    for t in base[:n // 2]:
        w = t.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w).upper() if rng.random() < .3 else " ".join(w))
    return out + [None, "", " \t\n", "one", "one", "a b c d", "A b c d", base[0] + " tail " + base[1]]


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org/en/12#z", "ftp://example.org",
            "http://notexample.org/es/1", "x://com/de/1", "http://a.com/fr/2", "http://q.net?u=://com/de/", "http://org/",
            "http://a.com/FR/2", "http://h.net//a/", "http://a.com/de"]
    rows = judge_urls(spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string"), URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fits = [x for x in URL_RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict == (best[2] if best else "block" if r.share >= 0.8 else "allow")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_templates_are_rejected_by_purity(spark):
    # /ads/ pages of the host are blocked by a rule; a page of the same merged template that no rule names is rejected
    rows = [(i, f"http://h.com/x{i % 40}q/{i}/ads") for i in range(400)] + [(1000 + i, f"http://h.com/ok/{i}") for i in range(400)]
    rules = [("h.com", f"/x{i}q/", "block") for i in range(39)] + [("h.com", "/ok/", "allow")]
    out = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[39].rule is None and out[39].verdict == "block"
    assert out[1000].verdict == "allow"


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i % 50, i, 0, rng.choice([3, 5, 7, 20, 33, 64, 64, 64]), "x") for i in range(700)]
    out = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, salt string"), 64).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.02 * sum(r[3] for r in rows) / 64 + 1
    assert pack(spark.createDataFrame([], "doc_id long, piece int, start long, length long"), 64).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_against_brute_force(spark, hot):
    texts = some_texts(2) + [" ".join(["r"] * 60), " ".join(["r"] * 40)]
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, texts), width=13, hot=hot).collect()}
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_text == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert remove_repeats(docs_of(spark, []) if False else spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    texts = some_texts(3)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts)).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), find(i), find(i) == i)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    odd = near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.component_id) for r in odd.collect()) == [(-1, 4), (-1, 4), (4, 4), (4, 4)]


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[n // 2:] = x[:n - n // 2] + rng.normal(size=(n - n // 2, 16)) * 0.05
    x[7] = x[3]
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 2)) for i, r in enumerate(x)]
    return rows + [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0),
                   (n + 4, rows[3][1], None), (n + 5, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2])]


VECTORS = "vec_id long, embedding array<float>, label int"


def usable(e):
    return e is not None and all(v is not None and np.isfinite(v) for v in e)


def test_top_k_against_brute_force(spark):
    rows = vectors(4)
    got = {}
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", class string")
    for r in top_k(frame, "vec_id", "embedding", F.col("id") % 10 == 0, k=10, sample=50, query_block=7, class_block=40, tile=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * v)) for v in e] for i, e, _ in rows if i is not None and usable(e)}
    assert set(got) == {i for i in ints if i % 10 == 0}
    for q, found in got.items():
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    few = top_k(frame.filter("vec_id < 4"), "vec_id", "embedding", F.col("id") == 0, k=10)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3]
    assert top_k(frame.filter("false"), "vec_id", "embedding", F.col("id") == 0).count() == 0


@pytest.mark.parametrize("tile", [2048, 9])
def test_pivots_against_brute_force(spark, tile):
    rows = vectors(5)
    unit = {k: np.array(e) / np.linalg.norm(e) for k, (_, e, l) in enumerate(rows) if usable(e) and any(e) and l is not None}
    links = {(a, b) for a in unit for b in unit if a != b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98}
    got = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label", tile=tile).collect()
    assert len(got) == len(rows)
    assert 0.9 * len(links) <= sum(r.n_links for r in got) <= len(links)
    by = {r.vec_id: r for r in got}
    assert by[3].n_links >= 2 and by[7].component_id == (3 if rows[7][2] == rows[3][2] else 7)
    for k in range(300, 305):
        assert (by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True)
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS), "vec_id", "embedding", "label").count() == 0


def test_encoding_is_best_and_decodes(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "Hello world", "a  b", "日本語 😀\n\tx", "</s><0x0A>", " lead", "x" * 300, "ab" * 200]
    texts += ["".join(rng.choice(["the", "ing", " ", "  ", "er", "é", "日", "\n"]) for _ in range(150)) for _ in range(20)]
    v, docs = u.vocabulary(model_path()), docs_of(spark, texts)
    score = {int(i): s for _, _, ids, ss in v.tables for i, s in zip(ids, ss)}
    plain = {r.doc_id: r for r in decode(encode(docs, model_path()), model_path()).collect()}
    split = {r.doc_id: r for r in decode(encode(docs, model_path(), giant=40, chunk=16, fan=2), model_path()).collect()}
    for i, t in enumerate(texts):
        assert plain[i].decoded == split[i].decoded == (t or "") and plain[i].uid == "u"
        total, _ = u._stretch(v, u.normalised(t))
        one, two = (sum(score.get(int(k), 0) for k in np.frombuffer(x[i].ids, "<u4")) for x in (plain, split))
        unknown = sum(v.unknown for k in u.normalised(t) if v.matches(np.array([k], np.uint32), np.array([1]))[1][0, 0] < 0)
        assert one == two == total - unknown
    assert encode(spark.createDataFrame([], DOCS), model_path()).count() == 0


def test_chat_links_orders_and_validates(spark):
    call = lambda i, name="t", a='{"b":1.0,"a":"x"}', after=None: (i, name, a, after)
    rows = [(1, 0, "user", "hi", None, None),
            (1, 1, "tool", "r1", None, "c1"),                       # comes before its call
            (1, 2, "assistant", "calls", [call("c1"), call("c2", a="{"), call("c3", "none"), call("c1")], None),
            (1, 3, "tool", "r2", None, "c2"), (1, 4, "tool", "r2 again", None, "c2"), (1, 5, "tool", "r9", None, "c9"),
            (1, 6, "assistant", None, [call("c4", after="c1"), call("c5", after="zz"), call("c6", after="c7"), call("c7", after="c6")], None),
            (1, 7, "tool", "r6", None, "c6"), (1, 8, "tool", "r7", None, "c7"),
            (None, None, None, "é\"", None, None), (2, 0, "user", "hi", None, None), (2, 0, "user", "hi", None, None)]
    schema = {"t": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "maxLength": 3}}}}
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, tool_calls {CALLS}, tool_call_id string")
    out = format_chat(frame, schema).collect()
    assert len(out) == len(rows) + 8
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(len(one)))
    at = {(r.kind, r.call_id, json.loads(r.message).get("content")): r for r in one}
    calls = [(r.call_id, r.status) for r in one if r.kind == "call"]
    assert sorted(calls) == sorted([("c1", "ok"), ("c1", "duplicate"), ("c2", "invalid"), ("c3", "unknown_tool"), ("c4", "unanswered"),
                                    ("c5", "waits_for_none"), ("c6", "cycle"), ("c7", "cycle")])
    first = min(r.position for r in one if r.kind == "call" and r.call_id == "c1" and r.status == "ok")
    assert first < at["result", "c1", "r1"].position
    assert at["result", "c2", "r2 again"].status == "duplicate" and at["result", "c9", "r9"].status == "orphan"
    good = next(r for r in one if r.call_id == "c1" and r.status == "ok")
    assert good.message == '{"arguments":{"a":"x","b":1},"id":"c1","name":"t"}'
    assert format_chat(frame.filter("false"), schema).count() == 0


def test_toxicity_without_labels_and_with(spark):
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else ("you grulk idiotx" if i % 5 == 0 else "a calm day") + f" t{i % 7}", i)
                                  for i in range(600)], "doc_id long, text string, score long")
    none = score_toxicity(docs, spark.createDataFrame([], "doc_id long, label int")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)} and len(none) == 600
    labels = docs.select("doc_id", (F.coalesce("text", F.lit("")).contains("grulk")).cast("int").alias("label")).filter("doc_id % 3 > 0")
    scored = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    right = sum(scored[i].predicted == int(i % 5 == 0 and i % 50 != 0) for i in range(0, 600, 3))
    assert right >= 0.95 * 200 and all(0 <= r.score <= 1 for r in scored.values())
    assert score_toxicity(docs.filter("false"), labels).count() == 0


def test_warc_round_trip(spark):
    trap = f"a\r\n\r\n{MAGIC}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{MAGIC}tail"
    htmls = ["x", "x", "", None, trap, trap + "é", MAGIC, "y" * 5000, "x"]
    rows = [(i, None if i == 7 else f"http://h/{i}\r\n", h, "d") for i, h in enumerate(htmls)] + [(None, "u", "lone", "d")]
    path = new_path(spark, "archives")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.page_id: r for r in read_archives(spark, path).collect()}
            assert len(got) == len(rows)
            for i, h in enumerate(htmls):
                raw = (h or "").encode()
                last = max(j for j, x in enumerate(htmls) if (x or "") == (h or ""))
                assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
                assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))
                assert got[i].verified
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    empty = new_path(spark, "archives")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert read_archives(spark, empty).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    # strays of a group meet in many buckets; without nearest rounds the last round does all the work
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        w = list(base)
        for j in rng.sample(range(200), rng.randint(2, 9)):
            w[j] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, texts), tile=16, nearest_rounds=0).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def grouped_vectors(n, seed=11, width=64):
    """Rows in order: a group of near copies of a third of all, groups of 300
    (a fifth of all), isolated pairs (a fifth), and the rest alone."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    part = np.zeros(n, int)
    third, fifth = n // 3, n // 5
    groups = [(0, third, 1)] + [(a, min(a + 300, third + fifth), 2) for a in range(third, third + fifth, 300)] \
        + [(a, a + 2, 3) for a in range(third + fifth, third + 2 * fifth - 1, 2)]
    for a, z, kind in groups:
        x[a:z] = np.sqrt(0.985) * x[a] + np.sqrt(0.015) * x[a:z]
        part[a:z] = kind
    x = x.astype(np.float32)
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = np.concatenate([(unit[i:i + 1000] @ unit.T >= 0.98).sum(1) for i in range(0, n, 1000)]) - 1
    return x, part, links


def test_pivots_keep_the_links_of_a_large_group(spark):
    x, part, links = grouped_vectors(20_000)
    frame = spark.createDataFrame([(i, r, 0) for i, r in enumerate(x.tolist())], VECTORS).repartition(8)
    found = np.zeros(len(x), int)
    for r in near_duplicate_vectors(frame, "vec_id", "embedding", "label").collect():
        found[r.vec_id] = r.n_links
    assert (found <= links).all()
    for kind in (1, 2, 3):      # a third of the rows, groups of hundreds, isolated pairs
        assert found[part == kind].sum() >= 0.99 * links[part == kind].sum() > 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(12)
    rows = [[float(v) for v in r] for r in rng.normal(size=(120, 4))]
    rows[:8] = [[300_000.5, 1, 0, 0], [400_000.5, 1, 0, 0], [500_000.5, -1, 0, 0], [0.5, 1e12, 0, 0], [0.25, -1e12, 0, 0],
                [0, 0, 1e25, 1], [0, 0, -1e25, 1], [0, 0, 1e160, 2]]
    rows += [[300_000.5, 1, 0, 0], [-0.0, 0, 0, 0], [0.0, 0, 0, 0], [1e300, 1e304, -1e300, 1]]
    rows = [[float(v) for v in r] for r in rows]
    ints = [[int(np.floor(1024 * v)) for v in r] for r in rows]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {}
    for r in top_k(frame, "vec_id", "embedding", F.col("id") >= 0, k=5, sample=40, query_block=50, class_block=40, tile=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    cut = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert len(got) == len(rows)
    for q, found in got.items():
        best = sorted((-cut(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in enumerate(ints) if i != q)[:5]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_pipeline_keeps_a_document_of_each_group(spark):
    from corpus_pipeline import drop_near_duplicates

    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, a), (5, "alone"), (None, a)], "doc_id long, text string")
    kept = drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (1, a), (2, a), (2, b), (5, "alone")])


def test_packing_program_beats_plain_best_fit():
    rng = np.random.default_rng(13)
    counts = np.bincount(rng.integers(40, 129, 6000), minlength=257)
    plan = plan_sequences(counts, 256)
    used = np.zeros(257, int)
    for config, times in plan:
        assert sum(l * k for l, k in config.items()) <= 256
        for l, k in config.items():
            used[l] += k * times
    assert (used == counts).all()
    assert sum(n for _, n in plan) < sum(n for _, n in _rounded(counts, 256, []))
    assert sum(n for _, n in plan) <= 1.002 * (counts * np.arange(257)).sum() / 256

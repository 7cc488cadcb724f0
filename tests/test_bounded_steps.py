"""Steps whose memory, shuffle or rows grew faster than their input."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verdict.llm import near_dedup
from verdict.operators import classifier, langid
from verdict.operators.idsets import _tested, container


def test_membership_looks_at_few_containers_at_once():
    ids = container(np.arange(0, 6000, 3, dtype=np.int64))
    n = 8000
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([ids] * n, pa.binary()), pa.array(np.arange(n) % 6000)], ["id", "_ids", "_at"])
    tracemalloc.start()
    found = np.concatenate([x.column("in").to_numpy(zero_copy_only=False) for x in _tested("in")([b])])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == (np.arange(n) % 6000 % 3 == 0)).all()
    assert most < 100e6


def test_language_by_any_split_of_the_model(spark):
    words = {"en": "the quick brown fox over lazy dogs", "de": "der schnelle braune fuchs und hunde", "fr": "le renard brun saute sur le chien"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[g].split()).tolist()), g) for i, g in enumerate([*words] * 8)]
    d = spark.createDataFrame([*rows, (90, None, "en"), (91, "ab", "de"), (92, "zzzz qqqq", None)], "doc_id long, text string, lang string")
    model, totals = langid.train(d, id_col="doc_id", text_col="text", lang_col="lang")
    kw = {"id_col": "doc_id", "text_col": "text"}
    want = sorted(langid.detect(d, model, totals, **kw, counts=langid.trigram_counts(d, "doc_id", "text")).collect())
    for frequent in (1, 40, 10**6):
        assert sorted(langid.detect(d, model, totals, **kw, frequent=frequent).collect()) == want
    # a text's trigrams are not shuffled, only its sums
    plan = langid.detect(d, model, totals, **kw)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, tri", plan)


def test_pairs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    pairs = spark.range(0, 60, 1, 2).select(F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("q"),
                                            F.array(F.rand(3).cast("float")).alias("c"), (F.col("id") % 3).cast("double").alias("y"))
    out = classifier.train_and_predict(pairs.mapInArrow(count, pairs.schema), claim_vec="q", evidence_vec="c", label="y")
    assert out.count() == 60
    assert out.select("prediction").filter("prediction is null").count() == 0
    assert made.value == 60


def test_settled_members_leave_the_rounds():
    """Of one bucket, two close sets of different components and two that are far from all."""
    rng = np.random.default_rng(3)
    far = [rng.integers(-2**62, 2**62, 16).tolist() for _ in range(3)]
    rows = [(7, 0, 0, i, i, 0, s, 400, None) for i, s in enumerate([far[0], far[0], far[1], far[2]])]
    b = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["key", "ti", "tj", "set_id", "component", "tile", "sketch", "size", "bands"])
    out = pa.Table.from_batches([*near_dedup._sketch_pairs(75, 4.0, True)(iter([b]))]).to_pylist()
    assert [(r["a"], r["b"]) for r in out if r["key"] is None] == [(0, 1)]
    assert sorted(r["a"] for r in out if r["key"] == 7) == [0, 1]


TILE = ["key", "ti", "tj", "set_id", "component", "tile", "sketch", "size", "bands", "shingles"]


def tile_rows(sets, tiles=1):
    """Sets of one bucket, all close by their sketches, each of a component of its own."""
    rows = [(7, t, int(t != i % tiles), i, i, i % tiles, [0] * 16, len(s), [7] * 32, s)
            for i, s in enumerate(sets) for t in range(tiles)]
    rows.sort(key=lambda r: r[:3])
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64()) if isinstance(c[0], list) else pa.int64()) for c in zip(*rows)], TILE)


def all_links(sets):
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len({*a} & {*b}) >= 75 * len({*a, *b})]


def closed(pairs, n):
    root = [*range(n)]
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def test_rows_of_the_last_round_grow_with_the_members():
    for n, tiles in ((20, 1), (60, 1), (60, 4)):    # of 190, 1770 and 1770 pairs
        out = pa.Table.from_batches([*near_dedup._sketch_pairs(75, 4.0, False)(iter([tile_rows([[1, 2, 3]] * n, tiles)]))]).to_pylist()
        assert sorted(r["a"] for r in out) == [*range(n)]
        assert {r["key"] for r in out} == {7}


def test_pairs_of_the_last_round_are_confirmed_where_they_meet():
    rng = np.random.default_rng(4)
    sets = []
    for base in range(3):       # three groups whose sets share about three quarters
        for _ in range(25):
            kept = rng.permutation(40)[:rng.integers(31, 39)]
            sets.append(sorted({*(1000 * base + kept).tolist(), *rng.integers(10**6, 10**9, 2).tolist()}))

    links = all_links(sets)
    for tiles in (1, 5):
        rows = tile_rows(sets, tiles)
        out = pa.Table.from_batches([*near_dedup._set_links(75, 4.0)(iter([rows.slice(0, 50), rows.slice(50)]))]).to_pylist()
        found = [(r["a"], r["b"]) for r in out]
        assert {(b, a) for a, b in found} <= {*links}
        assert closed(found, len(sets)) == closed(links, len(sets))
        assert len(set(closed(links, len(sets)))) > 3 and len(found) < len(sets) * tiles < len(links) * tiles
    assert not [*near_dedup._set_links(75, 4.0)(iter([]))]


def test_near_duplicates_by_any_tiles(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for j in rng.permutation(120)[:rng.integers(1, 7)]:
            w[j] = f"x{rng.integers(9)}"
        texts.append(" ".join(w))
    want = closed(all_links([{*zip(*(w[i:] for i in range(5)))} for w in (t.split() for t in texts)]), 90)
    assert len({*want}) > 3
    d = spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (92, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d, tile=7).collect()}
    assert got == {**dict(enumerate(want)), 90: 90, 91: 91, 92: want[0]}


def join_rows(plan):
    """(description, rows out) of the joins of an executed plan."""
    found = []
    if "Join" in plan.nodeName():
        found.append((plan.simpleString(100), plan.metrics().apply("numOutputRows").value()))
    children = plan.children()
    for i in range(children.size()):
        found += join_rows(children.apply(i))
    return found


def test_sets_are_joined_once_for_all_their_buckets(spark):
    sets, keys = 40, 16         # of the buckets, 12 hold two components and 4 one
    nodes = spark.createDataFrame([(i, [i] * 16, 1 + i, [i] * 32) for i in range(sets)],
                                  "set_id long, sketch array<long>, size long, bands array<long>")
    members = spark.createDataFrame([(k, i) for k in range(keys) for i in range(sets) if k < 12 or i > 20], "key long, set_id long")
    comp = spark.createDataFrame([(i, 20) for i in range(20, sets)], "node long, component long")
    full = spark.createDataFrame([(i, [*range(1 + i)]) for i in range(sets)], "set_id long, shingles array<long>")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for tile, with_sets in ((100, None), (15, None), (100, full), (15, full)):
            dealt = near_dedup._dealt(members, comp, nodes, tile, with_sets)
            got = dealt.collect()
            joins = [n for text, n in join_rows(dealt._jdf.queryExecution().executedPlan()) if "[set_id" in text]
            assert len(joins) >= 2 and max(joins) <= sets
            tiles = -(-sets // tile)
            homes = {(r.key, r.set_id): r for r in got if r.tj == 0}
            assert {*homes} == {(k, i) for k in range(12) for i in range(sets)}
            for (_, i), r in homes.items():
                assert (r.component, r.size, r.sketch, r.bands) == (min(i, 20), 1 + i, [i] * 16, [i] * 32)
                assert r.ti == r.tile < tiles and (with_sets is None or r.shingles == [*range(1 + i)])
            assert sorted((r.key, r.set_id, r.ti) for r in got) == sorted(
                (k, i, t) for (k, i), r in homes.items() for t in range(0 if with_sets is None else r.tile, tiles))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

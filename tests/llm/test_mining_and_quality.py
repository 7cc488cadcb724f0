"""Hard negatives, phrase collocations and quality rules against brute force, with
nulls, empty and very long texts, ties, repeated rows, empty tables and other
columns of clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdict.llm import collocations as c
from verdict.llm.collocations import collocations
from verdict.llm.hard_negatives import Bucket, Cell, _lengths, exact_scores, hard_negatives
from verdict.llm.quality_rules import _CLASS, Profile, distance, judge_quality

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VECS = "vec_id long, embedding array<double>, label int, anchor long, cells int"


def mined(rows, is_anchor, positives=5, negatives=3):
    """Plain version: rows are (id, vector, label)."""
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -2 ** 63), 2 ** 63 - 1)
    out = []
    for n, (i, v, y) in enumerate(rows):
        if not is_anchor(i):
            continue
        others = sorted((-score(v, w), j, m) for m, (j, w, z) in enumerate(rows) if m != n)
        near = [(-s, j) for s, j, m in others if rows[m][2] == y][:positives]
        for p, j in near:
            far = [(-s, k) for s, k, m in others if rows[m][2] != y and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(far)]
    return sorted(out)


def run_mined(spark, rows, every=5, **options):
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in rows], VECS)
    got = hard_negatives(df, "vec_id", "embedding", "label", F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 12))
    rows = [(i, (centre[rng.integers(6)] * rng.uniform(.3, 3) + rng.normal(size=12) * .4).tolist(), int(rng.integers(3))) for i in range(260)]
    rows += [(i, rows[4][1], 1) for i in range(300, 340)]                     # a hot vector, anchors among them
    rows += [(i, rows[4][1], 2) for i in range(340, 350)]                     # the same with another label
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]        # repeated rows
    rows += [(400, None, 1), (405, [1.0, None], 1), (410, [float("nan")] * 12, 1), (415, [float("inf")] * 12, 1),
             (None, rows[0][1], 1), (420, rows[0][1], None), (425, [0.0] * 12, 1), (430, [], 1), (435, [2.0, 1.0], 0)]
    want = mined(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    assert run_mined(spark, rows) == want
    # many small cells and few coordinates give the same rows
    assert run_mined(spark, rows, cell_bytes=64 * 96, anchor_bytes=64 * 96, focus=1) == want


def test_hard_negatives_of_very_large_components_and_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 4) * 10.0 ** int(rng.integers(0, 4) * 5)).tolist(), int(rng.integers(2))) for i in range(80)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0], i % 3) for i in range(100, 130)]
    assert run_mined(spark, rows) == mined(rows, lambda i: i % 5 == 0)
    assert run_mined(spark, []) == []
    assert run_mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []             # no positives


def test_pruning_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(7)
    rows = np.floor(rng.normal(size=(600, 16)) * 256)
    rows[:200] += np.floor(rng.normal(size=16) * 900)
    length, unit = _lengths(rows)
    pruned = 0
    for q in range(0, 600, 7):
        scores = exact_scores(rows, rows[q])
        coords = np.argsort(-np.abs(unit[q]))[:6]
        b = Bucket(np.arange(600), length, unit)
        for threshold in np.quantile(scores, [.3, .9, .99]):
            found = set(b.candidates(unit[q], length[q], coords, float(threshold)).tolist())
            assert set(np.flatnonzero(scores >= threshold).tolist()) <= found
            pruned += 600 - len(found)
    assert pruned > 10_000
    cell = Cell(np.arange(600), np.arange(600), np.zeros(600, np.int64), rows)
    assert sorted(np.concatenate([x.at for x in cell.buckets]).tolist()) == list(range(600))
    assert len(cell.buckets) > 3


def phrases_of(docs, support, first=2000, longest=4, scale=2_000_000, held=80):
    counts, n = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        count = counts.setdefault(lang, Counter())
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UP, LOW))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                count.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in counts.items():
        kept = {p: a for p, a in count.items() if a >= support and len(p) > 1}
        rows = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * f >= held * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, f in kept.items()):
                continue
            s, k = min((scale * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def some_docs(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "Straße", "A1", "über-all", "x\x85y", "　"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["In the long Run", "ad hoc", "w1 w1 w1"]
    out = []
    for _ in range(n):
        w = [rng.choice(fixed) if rng.random() < .1 else rng.choices(words, weights)[0] for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "en", "de", None]), "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]) for x in w)))
    return out + [("en", None), ("en", ""), ("fr", " \t. "), (None, "one"), ("en", "ad hoc " * 50)] + [("de", "same text here again")] * 40


@pytest.mark.parametrize("options", [{}, {"share": .02, "lowered": 1.0}, {"max_filter_bits": 1}, {"share": 1.0, "lowered": .1}])
def test_collocations_against_brute_force(spark, options):
    docs = some_docs(1, 400)
    df = spark.createDataFrame([(a, b, 1, "w", 5) for a, b in docs], "lang string, text string, n long, phrase string, words int")
    got = collocations(df, support=12, first=40, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_of(docs, 12, first=40)
    assert len(want) > 45 and {len(r[2].split(" ")) for r in want} >= {2, 3, 4}
    assert sorted(tuple(r) for r in got.collect()) == want


def test_collocations_in_runs_of_a_very_long_text(spark, monkeypatch):
    docs = [("en", " ".join(random.Random(3).choices(["a", "b", "c", "d", "the", "of"], k=400_000))), ("en", "z" * 1_000_000), ("en", " " * 1_000_000)]
    df = spark.createDataFrame(docs, "lang string, text string")
    want = phrases_of(docs, 30, first=100)
    assert sorted(tuple(r) for r in collocations(df, first=100).collect()) == want
    # phrases across the border of two runs are counted once
    texts, langs = pa.array([docs[0][1][:600]]), pa.array(["en"])

    class Held:
        value = b"\xff" * 8 * c._BLOCK
    rows = {}
    for run in (7, 1 << 19):
        monkeypatch.setattr(c, "RUN", run)
        n = Counter()
        for b in c._counts(4, Held, None)([pa.RecordBatch.from_arrays([texts, langs], ["text", "lang"])]):
            for r in b.to_pylist():
                n[r["key"]] += r["n"]
        rows[run] = n
    assert rows[7] == rows[1 << 19]


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_border_failures_are_counted_by_a_further_pass(spark):
    # two documents of the sample's size hold no phrase of the rest: everything frequent is a border failure
    docs = [("en", f"u{i} v{i}") for i in range(300)] + [("en", "alpha beta gamma delta")] * 40
    texts = spark.createDataFrame(docs, "lang string, text string")
    empty = spark.createDataFrame([], c._COUNTS)
    found = c._frequent(texts, 30, 4, empty, 1 << 20, c.Scratch())
    got = {(r.words, r.phrase): r.n for r in found.filter("words > 0").collect()}
    assert got[4, "alpha beta gamma delta"] == 40 and got[1, "alpha"] == 40 and len(got) == 10


def judged(docs, common=50, char_limit=.25, word_limit=.5, min_chars=200, min_words=50, min_reference=1000):
    classes = [lambda x: x in "aeiou", lambda x: x in "bcdfghjklmnpqrstvwxyz", lambda x: x in UP, lambda x: x in "0123456789",
               lambda x: x in " \t\n\v\f\r", lambda x: x in ".,;:!?'\"()-", None, lambda x: "À" <= x <= "ȿ", lambda x: x >= "\u0080"]

    def class_of(x):
        return next((i for i in (0, 1, 2, 3, 4, 5, 7, 8) if classes[i](x)), 6)
    base, chars, words = [], {}, {}
    for i, lang, text in docs:
        text, lang = text or "", lang or "und"
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        covered = {j + k for j in range(len(w) - 4) if grams[tuple(w[j:j + 5])] > 1 for k in range(5)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        hist = Counter(map(class_of, text))
        said = Counter(x.translate(str.maketrans(UP, LOW)) for x in w)
        if not failed:
            chars.setdefault(lang, Counter()).update(hist)
            words.setdefault(lang, Counter()).update(said)
        base.append((i, lang, len(text), hist, said, (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(covered)), failed))

    def js(p, q):
        if not sum(p):
            return 0.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        s = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q))
        return round(math.sqrt(min(max(s / 2, 0), 1)), 6)
    out = []
    for i, lang, size, hist, said, counts, failed in base:
        by_char = by_word = 0.0
        total = sum(words.get(lang, {}).values())
        if total >= min_reference:
            top = sorted(words[lang], key=lambda x: (-words[lang][x], x.encode()))[:common]
            by_char = js([hist[j] for j in range(9)], [chars[lang][j] for j in range(9)])
            by_word = js([said[x] for x in top] + [counts[0] - sum(said[x] for x in top)],
                         [words[lang][x] for x in top] + [total - sum(words[lang][x] for x in top)])
        far = (size >= min_chars and by_char > char_limit) or (counts[0] >= min_words and by_word > word_limit)
        out.append((i, *counts, failed, not failed and not far, by_char, by_word))
    return out


def test_quality_against_brute_force(spark):
    rng = random.Random(8)
    common = ["the", "of", "And", "to", "in", "Ärzte", "naïve", "日本"]
    docs = []
    for i in range(300):
        w = [rng.choice(common) if rng.random() < .5 else "".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(0, 150))]
        if i % 9 == 0:
            w = [x + rng.choice(["$$$", "%%%", "||", "#"]) for x in w]
        if i % 7 == 0 and w:
            w = w[:6] * 5 + w
        if i % 13 == 0:
            w = ["x" + x[::-1] + "q" for x in w]
        docs.append((i, rng.choice(["en", "en", None, "de", "xx" if i < 5 else "en"]), "".join(x + rng.choice([" ", " ", "\n", "\t", ". ", "\r\n", "\x0c"]) for x in w)))
    docs += [(1000, "en", None), (1001, "en", ""), (1002, "en", " \n\t\n "), (1003, None, "ü" * 1_000_000), (1004, "en", " " * 1_000_000),
             (1005, "en", "the of and " * 100_000), (None, "en", docs[20][2]), (20, *docs[20][1:]), (1006, "en", "a\nb\na\n\n \nb\r\nb\r\nb"),
             (1007, "en", "\x00\x01 \x7f é× ÷ ǿ €\U0001F600 " * 30)]
    df = spark.createDataFrame([(*d, 1, "x", True) for d in docs], "doc_id long, lang string, text string, n long, word string, kept boolean")
    got = [tuple(r) for r in judge_quality(df).collect()]
    want = judged(docs)
    key = repr
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert 20 < sum(r[7] for r in want) < 280 and any(not r[6] and not r[7] for r in want)


def test_quality_of_few_words_and_of_nothing(spark):
    rows = [("a", "en", "one two three four five six seven eight nine ten $$$ $$$ $$$ $$$")]
    r = judge_quality(spark.createDataFrame(rows, "doc_id string, lang string, text string")).first()
    assert r.doc_id == "a" and r.kept and r.char_distance == 0          # no reference of 1,000 words
    assert judge_quality(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    assert judge_quality(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).first().base_failed


def test_profile_and_distance():
    p = Profile(pa.array(["a b c d e a b c d e", None, "x"]))
    assert p.n_repeat_words.tolist() == [10, 0, 0] and p.n_words.tolist() == [10, 0, 1]
    assert distance(np.array([[1, 0], [0, 1], [2, 2], [0, 0]]), np.array([1, 0])).tolist() == [0, 1, round(math.sqrt(0.311278124459), 6), 0]
    assert _CLASS[ord("a")] == 0 and _CLASS[ord("|")] == 6

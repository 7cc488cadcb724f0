"""Toxicity: gradient-boosted trees over dense features of whole texts, with
isotonic calibration.

Features: densities of a lexicon (whole words and word stems), hits close to
second-person pronouns, capitals, punctuation and obfuscation. The lexicon is
learned: units that are significantly more frequent in toxic documents.
Training rows fall into three folds by doc_id: lexicon, trees, calibration, so
that the trees see the lexicon as it does on unseen text and the calibration
sees the trees so. All texts are scored in one pass; only narrow rows are
joined to labels.

Bounds: the fits read about ``max_rows`` labelled rows a fold (by hash of
doc_id); the lexicon has at most ``max_units`` units.

Nulls: a null text is empty; empty texts are scored by their features like
others. Labels with null doc_id or class are not used; of repeated label rows
the class 1 counts. Without both classes in every fold the score is the share
of class 1 among the training rows, 0 without any. Repeated rows are
scored each; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import _BYTE_LOWER, Words, mix64, slices

_U = np.uint64
STEMS = (4, 5, 6)   # bytes of a word's stem
# Second-person pronouns (English, German, French, Spanish)
SECOND_PERSON = ("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
                 "tú ti tus usted ustedes vosotros vuestro").split()
# Characters that stand for letters
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NEAR = 5            # words between a hit and a pronoun
FEATURES = ["words", "hit_density", "weight_density", "top_weight", "hits", "distinct_hits", "near_person",
            "person_density", "capitals", "shouted", "marks", "mark_runs", "disguised", "digits", "stars"]

_LETTER = np.zeros(256, bool)
for _r in (range(65, 91), range(97, 123), range(128, 256)):
    _LETTER[list(_r)] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "0123456789@$*"]] = True
_PLAIN = _BYTE_LOWER.copy()
for _a, _b in LOOKALIKES.items():
    _PLAIN[ord(_a)] = _BYTE_LOWER[ord(_b)]


def _units(w: Words) -> list[np.ndarray]:
    """Per word the hashes of its units: itself and its stems (0: too short)."""
    size = w.end - w.start
    out = [mix64(w.hashes(table=_PLAIN))]
    for k in STEMS:
        h = w.hashes(table=_PLAIN, prefix=k) + _U(k)
        h[size < k] = 0
        out.append(h)
    return out


def _words(column) -> Words:
    return Words(column, _LETTER | _SIGN)


_PRONOUNS = np.sort(_units(_words(pa.array([" ".join(SECOND_PERSON)])))[0])


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among the keys, -1 where it isn't one."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == x, at, -1)


def _unit_counts(batches):
    """(unit, toxic, clean): documents of a slice that hold the unit."""
    for b in slices(batches):
        w = _words(b.column("text"))
        label = b.column("label").to_numpy(zero_copy_only=False)
        keys, docs = [], []
        for h in _units(w):
            keys.append(h[h != 0]), docs.append(w.doc[h != 0])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
        key, toxic = key[first], label[doc[first]] == 1
        unit, at = np.unique(key, return_inverse=True)
        n1 = np.bincount(at, toxic, len(unit)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(unit.view(np.int64)), pa.array(n1), pa.array(np.bincount(at, minlength=len(unit)) - n1)],
            ["unit", "toxic", "clean"])


def learn_lexicon(texts: DataFrame, n_toxic: int, n_clean: int, max_units: int = 5000,
                  least_toxic: int = 3, least_ratio: float = 25.0) -> tuple[np.ndarray, np.ndarray]:
    """(sorted unit hashes, weights) from ``texts`` (text, label): units more
    frequent in toxic documents, by a log-likelihood ratio of ``least_ratio``."""
    share = n_toxic / max(n_toxic + n_clean, 1)
    if not 0 < share < 1:
        return np.zeros(0, np.uint64), np.zeros(0)
    a, c = F.col("a"), F.col("c")
    of_clean = F.when(c > 0, c * F.log(c / ((a + c) * (1 - share)))).otherwise(0)
    rows = (texts.select("text", "label").mapInArrow(_unit_counts, "unit long, toxic long, clean long")
            .groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c"))
            .filter(F.col("a") >= least_toxic)
            .withColumn("weight", F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1)))
            .withColumn("ratio", 2 * (a * F.log(a / ((a + c) * share)) + of_clean))
            .filter((F.col("ratio") >= least_ratio) & (F.col("weight") >= 1.5))
            .orderBy(F.desc("ratio"), "unit").select("unit", "weight").take(max_units))
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows])[order] if len(rows) else np.zeros(0)


def _features(keys: np.ndarray, weights: np.ndarray):
    def run(batches):
        for b in slices(batches):
            n = b.num_rows
            w = _words(b.column("text"))
            units = _units(w)
            weight = np.zeros(len(w.start))
            which = np.full(len(w.start), -1)
            for h in units:
                at = _member(keys, h)
                better = (at >= 0) & (np.r_[weights, 0.0][at] > weight)
                weight[better] = weights[at[better]]
                which[better] = at[better]
            total = np.diff(w.first).astype(float)
            per_word = np.maximum(total, 1)

            def count(flag, by=w.doc):
                return np.bincount(by[flag], minlength=n).astype(float)

            hit = weight > 0
            hits = count(hit)
            top = np.zeros(n)
            np.maximum.at(top, w.doc[hit], weight[hit])
            pairs = np.unique(np.stack([w.doc[hit], which[hit]], 1), axis=0)
            person = _member(_PRONOUNS, units[0]) >= 0
            at = np.flatnonzero(person)
            near = np.zeros(len(w.start), bool)
            if len(at):
                place = np.flatnonzero(hit)
                right = np.searchsorted(at, place)
                for k in (np.clip(right, 0, len(at) - 1), np.clip(right - 1, 0, len(at) - 1)):
                    near[place] |= (np.abs(at[k] - place) <= NEAR) & (w.doc[at[k]] == w.doc[place])
            raw, size = w.raw, np.maximum(np.diff(w.offsets), 1).astype(float)
            char_doc = np.repeat(np.arange(n), np.diff(w.offsets))
            upper = (raw >= 65) & (raw <= 90)
            mark = (raw == 33) | (raw == 63)
            runs = mark.copy()
            runs[1:] &= mark[:-1]
            runs[:1] = False

            def inside(flag):   # per word how many of its bytes are flagged
                c = np.r_[0, np.cumsum(flag)]
                return c[w.end] - c[w.start]

            letters, signs, caps = inside(_LETTER[raw]), inside(_SIGN[raw]), inside(upper)
            long = w.end - w.start
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(list(np.nan_to_num(np.stack([
                    np.log1p(total), hits / per_word, np.bincount(w.doc, weight, n) / per_word, top, np.log1p(hits),
                    np.log1p(np.bincount(pairs[:, 0].astype(int), minlength=n)),
                    count(near) / per_word, count(person) / per_word,
                    np.bincount(char_doc, upper, n) / size, count((caps == long) & (long > 2)) / per_word,
                    np.bincount(char_doc, mark, n) / size, np.bincount(char_doc, runs, n) / size,
                    count((letters > 0) & (signs > 0)) / per_word,
                    np.bincount(char_doc, (raw >= 48) & (raw <= 57), n) / size,
                    np.bincount(char_doc, raw == 42, n) / size], 1))), pa.list_(pa.float64()))],
                ["doc_id", "features"])
    return run


def _fold_of(column: str = "doc_id"):
    """0-4 lexicon, 5-7 trees, 8-9 calibration."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(column)), F.lit(10))


def _bounded(rows: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` of the rows, by a hash of doc_id (all, if fewer)."""
    n = rows.count()
    share = min(1.0, max_rows / max(n, 1))
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_units: int = 5000,
                   trees: int = 20, depth: int = 4, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text);
    ``labels`` (doc_id, label 0/1) are the rows to learn from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    labels = stored(labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id")
                    .agg(F.max("label").cast("int").alias("label")).withColumn("fold", _fold_of()), "labels")
    first = stored(_bounded(labels.filter("fold < 5"), max_rows).select("doc_id", "label"), "sample")
    n_toxic, n_clean = first.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    # the sample is bounded by max_rows, so it is sent to the tasks that read the texts
    keys, weights = learn_lexicon(docs.join(F.broadcast(first), "doc_id"), n_toxic, n_clean, max_units)
    rows = stored(docs.mapInArrow(_features(keys, weights), f"doc_id {kind}, features array<double>"), "features")
    known = rows.join(labels, "doc_id").select(array_to_vector("features").alias("features"), "label", "fold", "doc_id")
    fit = stored(_bounded(known.filter("fold between 5 and 7"), max_rows).select("features", "label"), "fit")
    tune = stored(_bounded(known.filter("fold > 7"), max_rows).select("features", "label"), "tune")
    both = all(part.select("label").distinct().count() == 2 for part in (fit, tune))
    if not both:
        share = labels.agg(F.avg("label")).first()[0] or 0.0
        scored = rows.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(fit)
        margin = vector_to_array("rawPrediction")[1]
        steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(
            model.transform(tune).select(margin.alias("margin"), F.col("label").cast("double")))
        scored = steps.transform(model.transform(rows.select(
            "doc_id", array_to_vector("features").alias("features"))).select("doc_id", margin.alias("margin")))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))

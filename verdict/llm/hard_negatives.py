"""Hard negatives by inner product, with coordinate pruning in length buckets.

Rows that share label and vector are one class. Classes are dealt to cells by hash;
each anchor class visits every cell of its own label for the positives, and every
cell of all labels for the negatives. In a cell:

1. Rows are sorted by length and cut into buckets whose lengths differ by at most
   a tenth (``_SHORTEST``). A bucket holds its vectors at length one and, per coordinate,
   a sorted list of their values.
2. An anchor asks for rows whose score reaches a threshold. Divided by the
   anchor's length and the bucket's greatest length it is a least cosine t. Over 1,
   the bucket is skipped. Else each row that can reach t has its value of coordinate f
   within a feasible range around the anchor's value. The ``focus`` greatest
   coordinates of the anchor each cut such a range out of their sorted list; the
   candidates are the intersection.
3. Candidates are scored exactly. Longer buckets go first, and what they find
   raises the threshold for the next.

For positives the threshold is the score that the anchor's last place has so far. For
negatives it is the least score of any of the anchor's windows, or the last place
within a window once it is filled.

Scores are exact sums of whole numbers; one that leaves a long is cut to the
least or greatest long. Windows are compared as whole numbers of any size.

Nulls: rows with a null id, label or vector, or null or non-finite components, take no
part. A shorter vector counts as ending in zeros. Repeated rows are rows of their own:
each can be an anchor, a positive and a negative. Ties go to the smaller id. A
label of one row has no positives; an empty table gives no rows. Other columns are not read.
Of a class only the ``positives`` + 1 rows of smallest id are kept as results, as no
others can come into one; its anchors are all kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import packed, stack, vectors
from .store import Scratch

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_SHORTEST = 0.9     # least length of a bucket, as a share of its greatest
_SLACK = 1e-9       # more than the rounding of lengths, values and thresholds
_SMALLEST = 32      # rows of a bucket, at least


def _integers(scale: int):
    def run(batches):
        for b in batches:
            flat, offsets, ok = vectors(b.column("vector"))
            with np.errstate(over="ignore"):
                whole = np.floor(np.nan_to_num(flat, posinf=0, neginf=0) * scale)
            ok &= np.r_[0, np.cumsum(~np.isfinite(whole))][offsets[1:]] == np.r_[0, np.cumsum(~np.isfinite(whole))][offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), packed(np.nan_to_num(whole) + 0.0, offsets, ok, "<f8")],
                ["id", "label", "vec"])
    return run


def exact_scores(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers with x, cut to a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(rows) @ np.abs(x) if len(rows) else np.zeros(0)
    if (most < 2.0 ** 53).all():                # every partial sum is an exact double
        return (rows @ x).astype(np.int64)
    whole = [int(v) for v in x]
    return np.array([min(max(sum(int(v) * w for v, w in zip(r, whole)), LEAST), MOST) for r in rows], np.int64)


def _lengths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, vector of length one) of each row; zero rows stay zero."""
    top = np.maximum(np.abs(rows).max(1, initial=0), 1e-300)[:, None]
    scaled = rows / top
    norm = np.sqrt((scaled * scaled).sum(1))
    with np.errstate(over="ignore"):
        return norm * top[:, 0], scaled / np.maximum(norm, 1e-300)[:, None]


class Bucket:
    """Rows of similar length with a sorted list for each coordinate."""

    def __init__(self, at: np.ndarray, length: np.ndarray, unit: np.ndarray):
        self.at, self.longest = at, float(length[at].max())
        unit = unit[at]
        self.order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(unit.T, self.order, 1)

    def candidates(self, unit: np.ndarray, length: float, coords: np.ndarray, threshold: float) -> np.ndarray:
        """Rows that may score ``threshold`` or more with the anchor."""
        reach = length * self.longest
        if not np.isfinite(reach):
            return self.at
        if reach == 0:
            return self.at if threshold <= 0 else self.at[:0]
        t = threshold / reach - _SLACK
        if t > 1:
            return self.at[:0]
        if t <= 0:
            return self.at          # a shorter row may reach it from any side
        found, hits = np.zeros(len(self.at), np.int8), 0
        for f in coords:
            q = float(unit[f])
            s = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - q * q))
            low = -1.0 if -q >= t else t * q - s - _SLACK
            high = 1.0 if q >= t else t * q + s + _SLACK
            a, z = np.searchsorted(self.sorted[f], (low - _SLACK, high + _SLACK))
            if a == 0 and z == len(self.at):
                continue
            found[self.order[f, a:z]] += 1
            hits += 1
        return self.at[found == hits]


class Cell:
    """Rows of one cell: length buckets, longest first."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.classes, self.labels, self.rows = ids, classes, labels, rows
        length, unit = _lengths(rows)
        order = np.argsort(-length, kind="stable")
        self.buckets, i = [], 0
        while i < len(order):
            j = int(np.searchsorted(-length[order], -_SHORTEST * length[order[i]], "right"))
            j = min(len(order), max(j, i + _SMALLEST))
            self.buckets.append(Bucket(order[i:j], length, unit))
            i = j

    def best(self, x: np.ndarray, keep, windows: list[tuple[int, int]], k: int, focus: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (least, greatest score) the (row, score) of the first k rows within it."""
        length, unit = _lengths(x[None])
        coords = np.argsort(-np.abs(unit[0]), kind="stable")[:focus]
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(windows)
        least = [low for low, _ in windows]
        for b in self.buckets:
            if not least:
                break
            at = b.candidates(unit[0], float(length[0]), coords, float(min(least)))
            at = at[keep(at)]
            if not len(at):
                continue
            score = exact_scores(self.rows[at], x)
            for w, (low, high) in enumerate(windows):
                inside = (score >= low) & (score <= high)
                rows, scores = np.r_[found[w][0], at[inside]], np.r_[found[w][1], score[inside]]
                if len(rows) > k:
                    first = np.lexsort((self.ids[rows], -scores.astype(object) if (scores == LEAST).any() else -scores))[:k]
                    rows, scores = rows[first], scores[first]
                found[w] = rows, scores
                if len(rows) == k:
                    least[w] = max(least[w], int(scores.min()))
        return found


def _cell(table: pa.Table, width: int) -> Cell:
    return Cell(*(table.column(c).to_numpy() for c in ("least_id", "class", "label")),
                stack(table.column("vec").to_pylist(), "<f8", width))


def _search(width: int, k: int, focus: int, own_label: bool):
    """One cell: per asked (anchor class, window) its first k classes."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            cell = _cell(rows, width)
            x = stack(anchors.column("vec").to_pylist(), "<f8", width)
            windows = anchors.column("windows").to_pylist()
            for i, (anchor, label) in enumerate(zip(anchors.column("anchor").to_pylist(), anchors.column("label").to_pylist())):
                keep = (lambda at: cell.labels[at] == label) if own_label else (lambda at: cell.labels[at] != label)
                found = cell.best(x[i], keep, [(w["low"], w["high"]) for w in windows[i]], k, focus)
                for w, (at, score) in zip(windows[i], found):
                    if len(at):
                        out.append((np.full(len(at), anchor), np.full(len(at), w["key"]), cell.classes[at], score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(cols, names=["anchor", "key", "class", "score"])
    return run


_FOUND = "anchor long, key long, class long, score long"


def _windows(least_share: int, most_share: int):
    """(anchor, key, low, high): the window of each score that a positive has."""
    def run(batches):
        for b in batches:
            score = b.column("score").to_pylist()
            low = [-(-least_share * s // 100) for s in score]
            high = [most_share * s // 100 for s in score]
            ok = pa.array([a <= z for a, z in zip(low, high)])
            yield pa.RecordBatch.from_arrays(
                [b.column("anchor"), b.column("score"), pa.array([max(v, LEAST) for v in low], pa.int64()),
                 pa.array([min(v, MOST) for v in high], pa.int64())], ["anchor", "key", "low", "high"]).filter(ok)
    return run


def _first(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(anchor, key, nth, member, score): the first k rows of each window."""
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "least_id")
    near = (found.join(classes.select("class", "least_id", "members"), "class")
            .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth"))
    by_row = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "member.id", "member.uid")
    return (near.select("anchor", "key", "score", F.explode("members").alias("member"))
            .withColumn("nth", F.row_number().over(by_row)).filter(F.col("nth") <= k))


def hard_negatives(rows: DataFrame, id_column: str, vector_column: str, label_column: str, is_anchor: Column,
                   positives: int = 5, negatives: int = 3, least_share: int = 50, most_share: int = 95,
                   scale: int = 256, focus: int = 6, cell_bytes: int = 4 << 20, anchor_bytes: int = 4 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each row where ``is_anchor`` (of column ``id``) holds and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels that score from ``least_share`` to ``most_share`` percent of the positive.

    ``focus``: coordinates that prune; ``cell_bytes`` and ``anchor_bytes``: vectors
    that meet in one task."""
    scratch = Scratch()
    whole = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
                        F.col(vector_column).alias("vector")).filter("id is not null and label is not null")
    whole = scratch.stored(whole.mapInArrow(_integers(scale), "id long, label long, vec binary").filter("vec is not null")
                           .withColumn("uid", F.monotonically_increasing_id()), "integers")
    # anchors are rows of their own; a class keeps the rows that can be results, cut before the shuffle
    nth = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id", "uid"))
    classes = scratch.stored(
        whole.withColumn("nth", nth).filter(F.col("nth") <= positives + 1).groupBy("label", "vec")
        .agg(F.sort_array(F.collect_list(F.struct("id", "uid"))).alias("members"))
        .withColumn("least_id", F.col("members")[0]["id"]).withColumn("class", F.monotonically_increasing_id()), "classes")
    named = classes.select(F.xxhash64("label", "vec").alias("hash"), F.col("label").alias("l"), F.col("vec").alias("v"), "class")
    asked = whole.filter(is_anchor)
    asked = scratch.stored(
        asked.join(named, (F.xxhash64("label", "vec") == F.col("hash")) & (F.col("vec") == F.col("v")) & (F.col("label") == F.col("l")))
        .select("id", "uid", F.col("class").alias("anchor")), "anchors")
    queries = scratch.stored(
        asked.select("anchor").distinct().join(classes.select(F.col("class").alias("anchor"), "label", "vec"), "anchor"), "queries")
    n, widest = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    width = max((widest or 0) // 8, 1)
    per_cell, per_ask = max(64, cell_bytes // (8 * width)), max(64, anchor_bytes // (8 * width))

    def parts(rows: DataFrame, per: int):
        return F.greatest(F.lit(1), F.ceil(F.count("*") / per)).cast("int")

    def meet(asks: DataFrame, by: list[str], asked_keys: list[str], k: int, own: bool) -> DataFrame:
        """Every ask in every cell of its key; cells and asks dealt by hash."""
        cells = classes.select("class", "label", "least_id", "vec")
        left = asks.withColumn("ask", F.pmod(F.xxhash64(F.lit(1), *asked_keys), "asks").cast("int")) \
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        right = cells.join(sizes, by) if by else cells.withColumns({"cells": F.lit(across), "asks": F.lit(down)})
        right = right.withColumn("cell", F.pmod(F.xxhash64(F.lit(2), "class"), "cells").cast("int")) \
            .withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        keys = [*by, "cell", "ask"]
        left, right = left.drop("cells", "asks"), right.drop("cells", "asks")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(width, k, focus, own), _FOUND)

    # positives: cells within a label, as many as its rows need
    sizes = scratch.stored(
        classes.groupBy("label").agg(parts(classes, per_cell).alias("cells"))
        .join(queries.groupBy("label").agg(parts(queries, per_ask).alias("asks")), "label"), "sizes")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(LEAST).cast("long").alias("low"),
                                  F.lit(MOST).cast("long").alias("high")))
    found = scratch.stored(meet(queries.join(sizes, "label").withColumn("windows", everything), ["label"], ["anchor"],
                                positives + 1, True), "near")
    # one more than ``positives``: the anchor's own row may be among them
    near = scratch.stored(_first(found, classes, positives + 1).drop("key"), "positives")
    windows = scratch.stored(near.select("anchor", "score").distinct().mapInArrow(
        _windows(least_share, most_share), "anchor long, key long, low long, high long"), "windows")
    # negatives: cells over all labels
    asks = queries.join(windows.groupBy("anchor").agg(
        F.collect_list(F.struct("key", "low", "high")).alias("windows")), "anchor")    # at most ``positives`` + 1
    across, down = max(1, -(-n // per_cell)), max(1, -(-queries.count() // per_ask))
    far = scratch.stored(meet(asks.withColumns({"cells": F.lit(across), "asks": F.lit(down)}), [], ["anchor"], negatives, False), "far")
    worst = scratch.stored(_first(far, classes, negatives).select(
        "anchor", F.col("key").alias("positive_score"), F.col("nth").alias("rank"), F.col("member.id").alias("negative_id"),
        F.col("score").alias("negative_score")), "negatives")
    # per anchor row: its class's positives but itself
    lists = scratch.stored(near.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("nth", "member", "score"))).alias("near")), "lists")
    chosen = (asked.join(lists, "anchor")
              .withColumn("near", F.slice(F.expr("filter(near, x -> x.member.uid <> uid)"), 1, positives))
              .select(F.col("id").alias("anchor_id"), "anchor", F.explode("near").alias("x"))
              .select("anchor_id", "anchor", F.col("x.member.id").alias("positive_id"), F.col("x.score").alias("positive_score")))
    return scratch.result(chosen.join(worst, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")

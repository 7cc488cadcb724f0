"""Embedding near-duplicates with a pivot-permutation index.

Equal vectors of one label are one class with a count. Each class is described
by its ``prefix`` nearest reference points (pivots) in order; inverted lists by
(label, pivot) hold the classes. Two classes of a list that share at least
``shared`` pivots are candidates and are verified by cosine in double precision.
A pair meets in every list of a shared pivot, but counts only in that of the
least one.

Lists are compared in tiles of bounded size. A tile leaves per class the number
of rows that it links to, and a star for each group of linked classes: pairs are
never written out.

Pivots are a sample of the classes by hash: the square root of their number,
from ``least_pivots`` to ``most_pivots``, taken from twice as many so that no two
have a cosine of ``apart`` or more. A group of near copies, however large, so has
one pivot of its own, and its members agree on the others as any near pair does.
If nearly all vectors are that close, few pivots are left and the lists are long:
more is compared, nothing is lost. Every row is indexed.

Nulls: rows whose label is null, and vectors that are null, zero or hold null or
non-finite components, link with nothing. A vector shorter than the widest counts
as ending in zeros. Repeated rows are vectors of their own and link. Rows with a
null id take part and count; the component id is the least id that is not null.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .dense import packed, stack, vectors
from .store import stored


def _units(batches):
    """Unit vectors, null where a vector links with nothing."""
    for b in batches:
        flat, offsets, ok = vectors(b.column("vector"))
        flat = np.nan_to_num(flat, posinf=0, neginf=0)
        row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        most = np.zeros(b.num_rows)
        np.maximum.at(most, row, np.abs(flat))
        ok &= most > 0
        scaled = flat / np.where(ok, most, 1)[row]     # no overflow of squares
        norm = np.sqrt(np.bincount(row, scaled ** 2, b.num_rows))
        unit = scaled / np.where(ok, norm, 1)[row]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("label"), packed(unit + 0.0, offsets, ok, "<f8")], ["id", "label", "vec"])


def _spaced(sample: np.ndarray, wanted: int, apart: float, step: int = 128) -> np.ndarray:
    """The first ``wanted`` of the sample that have no cosine of ``apart`` or
    more with one taken before."""
    kept, n = np.empty((min(wanted, len(sample)), sample.shape[1])), 0
    for i in range(0, len(sample), step):
        part = sample[i:i + step]
        part = part[(part @ kept[:n].T < apart).all(1)]
        among, new = part @ part.T, []
        for j in range(len(part)):
            if (among[j, new] < apart).all():
                new.append(j)
        new = new[:len(kept) - n]
        kept[n:n + len(new)] = part[new]
        n += len(new)
        if n == len(kept):
            break
    return kept[:n]


def _prefixes(pivots: np.ndarray, prefix: int):
    """The ordered nearest pivots of each vector."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                near = stack(part.column("vec").to_pylist(), "<f8", pivots.shape[1]) @ pivots.T
                best = np.argsort(-near, 1, kind="stable")[:, :prefix]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], [*part.schema.names, "prefix"])
    return run


def _linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, pivot: int, shared: int, cosine: float):
    """Pairs of a tile that share enough pivots, ``pivot`` being the least of
    them, and whose cosine is high enough."""
    common = np.zeros((len(x), len(y)), np.int16)
    earlier = np.zeros((len(x), len(y)), bool)
    for i in range(px.shape[1]):
        for j in range(py.shape[1]):
            same = px[:, i][:, None] == py[:, j][None, :]
            common += same
            earlier |= same & (px[:, i] < pivot)[:, None]
    a, b = np.nonzero((common >= min(shared, px.shape[1])) & ~earlier)
    near = np.empty(len(a))
    for i in range(0, len(a), 65_536):
        near[i:i + 65_536] = (x[a[i:i + 65_536]] * y[b[i:i + 65_536]]).sum(1)
    return a[near >= cosine], b[near >= cosine]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's group, by repeated minima."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(width: int, shared: int, cosine: float, step: int = 256):
    """Rows sorted by (label, pivot, ti, tj): per tile and class the rows that
    it links to and a class of its group."""
    def one(run):
        pivot, left, right = run[0][1:4]
        ids = np.array([r[4] for r in run], np.int64)
        rows = np.array([r[5] for r in run], np.int64)
        tile = np.array([r[6] for r in run])
        vec = stack([r[7] for r in run], "<f8", width)
        prefix = np.array([r[8] for r in run], np.int32)
        i, j = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
        links, pa_, pb_ = np.zeros(len(run), np.int64), [], []
        for s in range(0, len(i), step):
            part = i[s:s + step]
            a, b = _linked(vec[part], vec[j], prefix[part], prefix[j], pivot, shared, cosine)
            a, b = part[a], j[b]
            if left == right:   # each pair comes twice, and each class meets itself
                a, b = a[a != b], b[a != b]
                np.add.at(links, a, rows[b])
            else:
                np.add.at(links, a, rows[b])
                np.add.at(links, b, rows[a])
            pa_.append(a), pb_.append(b)
        hit = np.flatnonzero(links)
        root = _roots(len(run), np.concatenate(pa_ or [hit[:0]]), np.concatenate(pb_ or [hit[:0]]))
        return ids[hit], links[hit], ids[root[hit]]

    def run(batches):
        names = ("label", "pivot", "ti", "tj", "class", "n", "tile", "vec", "prefix")
        held: list[tuple] = []
        found: list[tuple] = []

        def rows():
            cols = [np.concatenate(c) for c in zip(*found)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["class", "links", "other"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names)):
                if held and held[0][:4] != r[:4]:
                    if len(held) > 1:
                        found.append(one(held))
                    held = []
                held.append(r)
            if sum(len(f[0]) for f in found) > 50_000:
                yield rows()
        if len(held) > 1:
            found.append(one(held))
        if found:
            yield rows()
    return run


def near_duplicate_vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str,
                           cosine: float = 0.98, prefix: int = 8, shared: int = 2, tile: int = 2048,
                           least_pivots: int = 64, most_pivots: int = 65_536, apart: float = 0.9) -> DataFrame:
    """(<id_column>, n_links, component_id, kept) for every row; links need
    equal labels and ``cosine`` or more. No two pivots are as near as ``apart``."""
    whole = rows.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    types = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    whole = stored(whole.mapInArrow(_units, f"id {types['id']}, label {types['label']}, vec binary")
                   .withColumn("key", F.xxhash64("label", "vec")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    classes = stored(whole.filter("label is not null and vec is not null").groupBy("key", "label", "vec")
                     .agg(F.count("*").alias("n"), F.min("id").alias("least"))
                     .withColumn("class", F.monotonically_increasing_id()), "classes")
    n, wide = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    width = (wide or 0) // 8
    wanted = min(most_pivots, max(least_pivots, math.isqrt(n)))
    picked = [r[0] for r in classes.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").take(2 * wanted)]
    pivots = _spaced(stack(picked, "<f8", width), wanted, apart)
    indexed = stored(classes.select("class", "label", "n", "vec").mapInArrow(
        _prefixes(pivots, prefix),
        f"class long, label {types['label']}, n long, vec binary, prefix array<int>"), "index")
    lists = indexed.withColumn("pivot", F.explode("prefix"))
    sizes = (lists.groupBy("label", "pivot").agg(F.count("*").alias("tiles")).filter("tiles > 1")
             .select(F.xxhash64("label", "pivot").alias("hash"), F.col("label").alias("l"), F.col("pivot").alias("p"),
                     F.ceil(F.col("tiles") / tile).cast("int").alias("tiles")))
    # the key is hashed anew, so that both sides are shuffled and Spark can split a long list
    placed = (lists.join(sizes, (F.xxhash64("label", "pivot") == F.col("hash")) & (F.col("label") == F.col("l"))
                         & (F.col("pivot") == F.col("p")))
              .withColumn("tile", F.expr("pmod(xxhash64(class), tiles)").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other")))
    names = ["label", "pivot", "ti", "tj", "class", "n", "tile", "vec", "prefix"]
    links = stored(placed.select(names).repartition("label", "pivot", "ti", "tj")
                   .sortWithinPartitions("label", "pivot", "ti", "tj")
                   .mapInArrow(_tiles(width, shared, cosine), "class long, links long, other long"), "links")
    totals = links.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(links.select("class", "other")).select(F.col("node").alias("class"), "component")
    known = (classes.join(totals, "class", "left").join(groups, "class", "left")
             .withColumn("component", F.coalesce("component", "class")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id")) \
        .select(F.xxhash64("component").alias("hash"), F.col("component").alias("c"), "component_id")
    known = known.join(least, (F.xxhash64("component") == F.col("hash")) & (F.col("component") == F.col("c"))) \
        .select("key", F.col("label").alias("l"), F.col("vec").alias("v"), "n", "links", "component_id")
    # rows that link with nothing meet nobody; their own number spreads them
    at = F.when(F.col("vec").isNotNull() & F.col("label").isNotNull(), F.xxhash64(F.lit(1), "key")).otherwise(F.xxhash64(F.lit(2), "uid"))
    out = (whole.withColumn("at", at).drop("key")
           .join(known.withColumn("hash", F.xxhash64(F.lit(1), "key")).drop("key"),
                 (F.col("at") == F.col("hash")) & (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")), "left"))
    component = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

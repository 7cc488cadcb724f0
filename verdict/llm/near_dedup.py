"""MinHash near-duplicates with odd sketches.

A text is lower-cased (A-Z), cut to words and to its set of distinct
``width``-word shingles (a text with fewer words is one shingle). Equal sets
are one node. Bands of MinHash values propose pairs; odd sketches (MinHash
samples folded to parity bits, whose XOR counts the samples that differ) drop
the hopeless ones; the rest are confirmed on the full sets.

Groups are never spread to all pairs: the members of a band's bucket are
compared to the bucket's least node and links are closed to components. Members
still in different components of one bucket are compared further, by tiles: a
task holds the sketches of one tile and the other tiles of the bucket pass by. In
the first ``nearest_rounds`` rounds only each one's nearest of
another component leaves the task and is confirmed, which joins what a large
group of near copies is made of. A
member that had no close sketch of another component in a bucket takes no part in that
bucket's later rounds. In the last round all pairs that are still apart are confirmed
where they meet: the full sets of members that have a close sketch come to
the tiles, and of the links only those that join two components leave the task. So
the rows of a round grow with a bucket's members, not with its pairs.

The bands use 128 MinHash values; with 32 bands of 4 a pair at similarity 0.75 is
missed with probability 5e-6. The sketch folds the least element of each of 1024
parts of the hash range (MinHash by one permutation; of small sets nearly all
elements, so that their estimate is nearly exact). Pairs are confirmed up to
``sigmas`` standard errors beyond the difference that sets of their sizes have at
the similarity of a link.

Nulls: null texts, empty texts and texts without words have an empty set and
link with nothing. Repeated rows each get their row. Rows with null doc_id take
part, but the component id is the least doc_id that is not null.
"""

from __future__ import annotations

from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, release
from .words import Words, constants, mix64, runs, slices

_U = np.uint64
BANDS, ROWS, SAMPLES, SKETCH_BITS = 32, 4, 1024, 1024
SKETCH_LONGS = SKETCH_BITS // 64
#: Guests that a tile meets at once; elements of full sets that a tile has room for, per member.
GUESTS, ELEMENTS = 2048, 1024
_MUL = (constants(201, BANDS * ROWS) >> _U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (constants(202, BANDS * ROWS) >> _U(32)).astype(np.uint32)


def _shingle_sets(b: pa.RecordBatch, width: int):
    """Per row of the batch its sorted distinct shingle hashes."""
    w = Words(b.column("text"))
    h = w.hashes(lower=True)
    s = runs(h, width, 203)
    for i in range(b.num_rows):
        a, z = w.first[i], w.first[i + 1]
        if z - a >= width:
            yield np.unique(s[a:z - width + 1])
        elif z > a:
            with np.errstate(over="ignore"):
                yield mix64((h[a:z] * constants(204, width)[:z - a]).sum(dtype=np.uint64, keepdims=True) + _U(z - a))
        else:
            yield h[:0]


def _set_id(s: np.ndarray) -> int:
    return int(mix64(mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + _U(len(s))).view(np.int64)[0])


def _minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> _U(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 8192):
        least = np.minimum(least, (_MUL[:, None] * x[None, i:i + 8192] + _ADD[:, None]).min(1))
    return least


def _signatures(width: int):
    band_mul = constants(205, ROWS)
    band_seed = constants(206, BANDS)

    def run(batches):
        for b in slices(batches):
            n, ids, bands, sketches = [], [], [], []
            for s in _shingle_sets(b, width):
                n.append(len(s))
                if not len(s):
                    ids.append(None), bands.append(None), sketches.append(None)
                    continue
                ids.append(_set_id(s))
                m = _minhash(s).astype(np.uint64)
                with np.errstate(over="ignore"):
                    bands.append(mix64((m.reshape(BANDS, ROWS) * band_mul).sum(1, dtype=np.uint64) + band_seed).view(np.int64))
                    part = (s >> _U(40)) * _U(SAMPLES) >> _U(24)    # s is sorted
                    least = s[np.r_[True, part[1:] != part[:-1]]]
                    at = mix64(least + _U(207)) % _U(SKETCH_BITS)
                bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
                sketches.append(np.packbits(bits, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("doc_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "doc_key", "n_shingles", "set_id", "bands", "sketch"])
    return run


def _sets(width: int):
    def run(batches):
        for b in slices(batches):
            sets = list(_shingle_sets(b, width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "shingles"])
    return run


def most_different_bits(both, percent: int, sigmas: float, exp=np.exp, sqrt=lambda x: np.sqrt(np.abs(x))):
    """Sketch bits that may differ in a link of two sets with ``both`` elements
    together (an array, or a column with its functions)."""
    j = percent / 100
    union = both / (1 + j)
    full = 1 - exp(-union / SAMPLES)                                  # parts with an element
    differ = 2 * SAMPLES * (1 - exp(-both / (2 * SAMPLES)) - j * full)    # samples of one set only
    shrink = exp(-2 * differ / SKETCH_BITS)
    sampling = 4 * SAMPLES * full * j * (1 - j) * (1 - SAMPLES * full / union) * shrink * shrink
    folding = SKETCH_BITS / 4 * (1 - shrink * shrink) - differ * shrink * shrink
    return SKETCH_BITS / 2 * (1 - shrink) + sigmas * sqrt(sampling + folding) + 1


def _tiles(batches):
    """Per (key, ti) of sorted rows its members (rows with tj 0, one batch) and the
    guests they are compared to (the others, in pieces)."""
    def parts():
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in ("key", "ti", "tj")])
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            for i, j in zip(np.r_[0, cut], np.r_[cut, b.num_rows]):
                for at in range(i, j, GUESTS):
                    yield k[:, i].tolist(), b.slice(at, min(GUESTS, j - at))

    for (key, _), run in groupby(parts(), lambda p: p[0][:2]):
        turns = groupby(run, lambda p: p[0][2])
        tj, own = next(turns)
        if tj == 0:     # a tile that got no members has nobody to compare
            home = pa.Table.from_batches([p for _, p in own]).combine_chunks().to_batches()[0]
            yield key, home, (p for _, guests in turns for _, p in guests)


class _Side:
    """Columns of a tile or of guests as arrays."""

    def __init__(self, b: pa.RecordBatch, bands: bool = True):
        self.node = b.column("set_id").to_numpy()
        self.comp = b.column("component").to_numpy()
        self.size = b.column("size").to_numpy()
        self.sketch = b.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_LONGS)
        self.bands = b.column("bands").flatten().to_numpy().reshape(-1, BANDS) if bands else None


def _limits(percent: int, sigmas: float) -> np.ndarray:
    """Sketch bits that may differ, by the elements of both sets."""
    most = 1 << 16      # beyond, the limit hardly changes and is taken at its end
    limits = most_different_bits(np.r_[1, 1:most, 1e12].astype(float), percent, sigmas).astype(np.uint16)
    limits[most - 1] = limits[most]
    return limits[:most]


def _meetings(x: _Side, guests, bands: bool):
    """(y, i, j, same): rows i of a tile to be compared to rows j of y, which is the
    tile itself (same) or guests; and the members that are not of the tile's commonest
    component, whose members need no look at each other."""
    c, count = np.unique(x.comp, return_counts=True)
    most = c[count.argmax()] if 2 * count.max() > len(x.comp) else None
    rest = np.arange(len(x.comp)) if most is None else np.flatnonzero(x.comp != most)

    def blocks():
        for y, same in chain([(x, True)], ((_Side(g, bands), False) for g in guests)):
            sides = [(rest, np.arange(len(y.comp)))]
            if most is not None and not same:
                sides.append((np.flatnonzero(x.comp == most), np.flatnonzero(y.comp != most)))
            for i, j in sides:
                if len(j):
                    yield from ((y, i[k:k + 256], j, same) for k in range(0, len(i), 256))
    return rest, blocks()


def _distances(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, percent: int, limits: np.ndarray) -> np.ndarray:
    """Differing sketch bits; SKETCH_BITS + 1 where no link of two components can be."""
    d = np.zeros((len(i), len(j)), np.uint16)
    for k in range(SKETCH_LONGS):
        d += np.bitwise_count(x.sketch[i, k][:, None] ^ y.sketch[j, k][None, :])
    u, v = x.size[i][:, None], y.size[j][None, :]
    d[(x.comp[i][:, None] == y.comp[j][None, :]) | (100 * np.minimum(u, v) < percent * np.maximum(u, v))
      | (d > limits[np.minimum(u + v, len(limits) - 1)])] = SKETCH_BITS + 1
    return d


def _close_here(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, key: int, percent: int, limits: np.ndarray):
    """Rows (p of x, q of y) with close sketches whose first common band is this one:
    a pair that shares several buckets is looked at in one of them, there or
    before as a pair with the bucket's hub."""
    p, q = np.nonzero(_distances(x, i, y, j, percent, limits) <= SKETCH_BITS)
    p, q = i[p], j[q]
    first = [np.zeros(0, bool)]
    for k in range(0, len(p), 65536):
        u, v = x.bands[p[k:k + 65536]], y.bands[q[k:k + 65536]]
        first.append(u[np.arange(len(u)), (u == v).argmax(1)] == key)
    first = np.concatenate(first)
    return p[first], q[first]


def _gathered(tables, rows: int = 50_000):
    """Small batches put together."""
    found, size = [], 0
    for t in tables:
        found.append(t)
        size += t.num_rows
        if size > rows:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            found, size = [], 0
    if found:
        yield from pa.Table.from_batches(found).combine_chunks().to_batches()


def _sketch_pairs(percent: int, sigmas: float, nearest: bool):
    """Rows sorted by (key, ti, tj), see _tiles. As (key, a) each member of a tile that has a
    close sketch of another component (where not nearest, of a pair to be looked at in this bucket);
    where nearest, also its nearest one (a, b; key null). At most two rows for a member."""
    limits = _limits(percent, sigmas)

    def met(key, home, guests):
        x = _Side(home, not nearest)
        n = len(x.node)
        live, least, who = np.zeros(n, bool), np.full(n, SKETCH_BITS + 1, np.uint16), np.zeros(n, np.int64)
        rest, blocks = _meetings(x, guests, not nearest)
        for y, i, j, same in blocks:
            if nearest:
                d = _distances(x, i, y, j, percent, limits)
                p, q = np.nonzero(d <= SKETCH_BITS)
                p, q = i[p], j[q]
                at = d.argmin(1)
                d = d[np.arange(len(i)), at]
                better = d < least[i]
                least[i[better]], who[i[better]] = d[better], y.node[j[at[better]]]
            else:
                p, q = _close_here(x, i, y, j, key, percent, limits)
            live[p] = True
            if same:
                live[q] = True
        p = rest[least[rest] <= SKETCH_BITS]
        p = np.unique(np.stack([np.minimum(x.node[p], who[p]), np.maximum(x.node[p], who[p])], 1), axis=0)
        n, k = len(p), int(live.sum())
        key = pa.array(np.full(n + k, key, np.int64), mask=np.arange(n + k) < n)
        b = pa.array(np.r_[p[:, 1], np.zeros(k, np.int64)], mask=np.arange(n + k) >= n)
        return pa.RecordBatch.from_arrays([key, pa.array(np.r_[p[:, 0], x.node[live]]), b], ["key", "a", "b"])

    def run(batches):
        yield from _gathered(met(*t) for t in _tiles(batches))
    return run


def _set_links(percent: int, sigmas: float):
    """Rows sorted by (key, ti, tj), see _tiles, with their full sets: links (a, b) that reach the
    similarity, of each task only those that join components it has not joined yet."""
    limits = _limits(percent, sigmas)

    def find(joined, c):
        while c in joined:
            c = joined[c]
        return c

    def sets(b):
        """Values, first place and length of each row's set."""
        n = b.column("shingles").value_lengths().to_numpy().astype(np.int64)
        return b.column("shingles").flatten().to_numpy(), np.r_[0, n.cumsum()], n

    def links(key, home, guests):
        x = _Side(home)
        values, start, _ = sets(home)
        words, codes = np.unique(values, return_inverse=True)
        seen, joined, out = np.zeros(len(words) + 1, bool), {}, []
        places = {id(x): (codes, start)}

        def placed(guests):
            for g in guests:
                v, s, _ = sets(g)
                at = np.searchsorted(words, v)
                at[at == len(words)] = 0
                places["guests"] = np.where(words[at] == v, at, len(words)), s
                yield g

        mine = x.comp.copy()    # what is one already, by the links found here
        theirs = last = None
        for y, i, j, same in _meetings(x, placed(guests), True)[1]:
            if y is not last:
                c, at = np.unique(y.comp, return_inverse=True)
                theirs = mine if same else np.array([find(joined, k) for k in c.tolist()], np.int64)[at]
                last, (code, first) = y, places[id(x)] if same else places["guests"]
            p, q = _close_here(x, i, y, j, key, percent, limits)
            for r, g in zip(*_split(p, q)):
                g = g[theirs[g] != mine[r]]
                if not len(g):
                    continue
                own = codes[start[r]:start[r + 1]]
                seen[own] = True
                n = y.size[g]
                ends = n.cumsum()
                hit = seen[code[np.arange(ends[-1]) + np.repeat(first[g] - (ends - n), n)]]
                common = np.add.reduceat(hit, ends - n, dtype=np.int64)
                seen[own] = False
                g = g[100 * common >= percent * (x.size[r] + n - common)]
                for old, at in zip(*np.unique(theirs[g], return_index=True)):
                    out.append((x.node[r], y.node[g[at]]))
                    joined[int(old)] = int(mine[r])
                    theirs[theirs == old] = mine[r]
                    mine[mine == old] = mine[r]
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a.min(1)), pa.array(a.max(1))], ["a", "b"])

    def run(batches):
        yield from _gathered(links(*t) for t in _tiles(batches))
    return run


def _split(p: np.ndarray, q: np.ndarray):
    """The distinct values of p, which is sorted, and the q of each."""
    cut = np.flatnonzero(p[1:] != p[:-1]) + 1
    return p[np.r_[0, cut]] if len(p) else p, np.split(q, cut) if len(p) else []


def _close_enough(pairs: DataFrame, nodes: DataFrame, percent: int, sigmas: float) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    n = nodes.select("set_id", "sketch", "size")
    p = (pairs.join(n.select(F.col("set_id").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("m")), "a")
         .filter("m > 0")
         .join(n.select(F.col("set_id").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("n")), "b"))
    differ = sum((F.expr(f"bit_count(x[{i}] ^ y[{i}])") for i in range(SKETCH_LONGS)), F.lit(0))
    limit = most_different_bits((F.col("m") + F.col("n")).cast("double"), percent, sigmas, F.exp, lambda x: F.sqrt(F.abs(x)))
    return p.filter((100 * F.least("m", "n") >= percent * F.greatest("m", "n")) & (differ <= limit)).select("a", "b")


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of the distinct set_id in ``wanted``."""
    wanted = wanted.join(nodes.select("set_id", "some_doc"), "set_id")
    rows = docs.join(wanted.select(F.col("some_doc").alias("doc_key")).distinct(), "doc_key", "left_semi")
    return (rows.select("text").mapInArrow(_sets(width), "set_id long, shingles array<long>")
            .join(wanted.select("set_id"), "set_id", "left_semi")
            .groupBy("set_id").agg(F.first("shingles").alias("shingles")))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity on their full sets."""
    wanted = (pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id")))
              .distinct())
    sets = _full_sets(wanted, nodes, docs, width)
    both = (pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
            .withColumn("common", F.size(F.array_intersect("x", "y"))))
    union = F.size("x") + F.size("y") - F.col("common")
    return both.filter(100 * F.col("common") >= percent * union).select("a", "b")


def _by_hash(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join to an aggregate on its key, hashed anew: both sides are then
    shuffled for the join, so Spark can split the rows of a hot key."""
    r = right.withColumnRenamed(key, "_key").withColumn("_hash", F.xxhash64("_key"))
    return left.join(r, (F.xxhash64(left[key]) == r["_hash"]) & (left[key] == r["_key"]), how).drop("_key", "_hash")


def _dealt(members: DataFrame, comp: DataFrame, nodes: DataFrame, tile: int, sets: DataFrame | None = None) -> DataFrame:
    """Members (key, set_id) of buckets with different components, dealt by (key, ti) and sorted: of
    tile ti itself (tj 0) and the guests it meets (tj 1). These are all other tiles; with sets,
    where a link found on one side is enough, those before, and a tile is small in elements as well.
    What belongs to a set (component, size, sketch) is joined once for all of its buckets, sketches and
    full sets only where a bucket is left."""
    m = (members.groupBy("set_id").agg(F.collect_list("key").alias("keys"))
         .join(comp.withColumnRenamed("node", "set_id"), "set_id", "left")
         .withColumn("component", F.coalesce("component", "set_id"))
         .join(nodes.select("set_id", "size"), "set_id")
         .select("set_id", "component", "size", F.explode("keys").alias("key")))
    apart = (m.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                   F.count("*").alias("n"), F.sum("size").alias("elements"))
             .filter("c0 <> c1").select("key", "n", "elements"))
    m = (_by_hash(m, apart, "key").groupBy("set_id", "component", "size")
         .agg(F.collect_list(F.struct("key", "n", "elements")).alias("buckets"))
         .join(nodes.select("set_id", "sketch", "bands"), "set_id"))
    if sets is None:
        tiles, least = F.ceil(F.col("n") / tile).cast("int"), F.lit(0)
    else:
        tiles = F.ceil(F.greatest(F.col("n") / tile, F.col("elements") / (tile * ELEMENTS))).cast("int")
        least = F.col("tile")
        m = m.join(sets, "set_id")
    m = m.withColumn("bucket", F.explode("buckets")).select("*", "bucket.*").drop("buckets", "bucket")
    return (m.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))
            .withColumn("ti", F.explode(F.sequence(least, F.col("tiles") - 1)))
            .withColumn("tj", (F.col("ti") != F.col("tile")).cast("int"))
            .drop("tiles", "n", "elements").repartition("key", "ti").sortWithinPartitions("key", "ti", "tj"))


def _left_over(members: DataFrame, comp: DataFrame, nodes: DataFrame, percent: int, sigmas: float, tile: int, nearest: bool) -> DataFrame:
    """Of members (key, set_id): those (key, a) that have a close sketch of another component
    in their bucket and, where nearest, the pairs (a, b; key null) of each with its nearest."""
    return (_dealt(members, comp, nodes, tile)
            .select("key", "ti", "tj", "set_id", "component", "tile", "sketch", "size",
                    *([F.lit(None).cast("array<long>").alias("bands")] if nearest else ["bands"]))
            .mapInArrow(_sketch_pairs(percent, sigmas, nearest), "key long, a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, sigmas: float = 4.0,
                    tile: int = 2048, nearest_rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``
    (doc_id, text). ``percent``: similarity of a link; ``sigmas``: standard
    errors of the sketch up to which a pair is confirmed; ``tile``: members that a
    task compares to the rest of their bucket."""
    scratch = Scratch()
    stored = scratch.stored
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    rows = stored(docs.mapInArrow(
        _signatures(width), "doc_id long, doc_key long, n_shingles long, set_id long, "
                            "bands array<long>, sketch array<long>"), "signatures")
    nodes = stored(rows.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("min_doc"), F.min("doc_key").alias("some_doc"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("n_shingles").alias("size")), "sets")
    in_bands = nodes.select("set_id", F.explode("bands").alias("key"))
    hubs = in_bands.groupBy("key").agg(F.min("set_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = stored(_by_hash(in_bands, hubs, "key").filter("set_id <> hub"), "members")
    star = members.select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct()
    tried = stored(_close_enough(star, nodes, percent, sigmas), "pairs")
    comp = components(stored(_confirmed(tried, nodes, docs, width, percent), "links"), stored=stored)
    apart = members.filter("n > 2").select("key", "set_id")
    for _ in range(nearest_rounds):
        met = stored(_left_over(apart, comp, nodes, percent, sigmas, tile, True), "met")
        # components only grow: a member without a close one of another component stays so
        apart = met.filter("key is not null").select("key", F.col("a").alias("set_id"))
        more = stored(met.filter("key is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        release(docs.sparkSession)
        if more.isEmpty():
            break
        links = stored(_confirmed(more, nodes, docs, width, percent), "links")
        if links.isEmpty():     # another round would find the same ones again
            break
        comp = components(comp.toDF("a", "b").unionByName(links), stored=stored)
        tried = tried.unionByName(more)
    met = stored(_left_over(apart, comp, nodes, percent, sigmas, tile, False), "met").select("key", F.col("a").alias("set_id"))
    sets = _full_sets(met.select("set_id").distinct(), nodes, docs, width)
    links = stored(_dealt(met, comp, nodes, tile, sets)
                   .select("key", "ti", "tj", "set_id", "component", "sketch", "size", "bands", "shingles")
                   .mapInArrow(_set_links(percent, sigmas), "a long, b long"), "links")
    release(docs.sparkSession)
    if not links.isEmpty():
        comp = components(comp.toDF("a", "b").unionByName(links), stored=stored)
    named = (nodes.select("set_id", "min_doc").join(comp.withColumnRenamed("node", "set_id"), "set_id", "left")
             .withColumn("component", F.coalesce("component", "set_id")))
    least = named.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    named = _by_hash(named, least, "component").select(F.col("set_id").alias("node"), "component_id")
    named = named.withColumn("hash", F.xxhash64("node"))
    # rows without a set meet nobody; their own hash spreads them
    at = F.when(rows.set_id.isNotNull(), F.xxhash64(rows.set_id)).otherwise(F.xxhash64(rows.doc_key))
    return scratch.result(
        rows.join(named, (at == named["hash"]) & (rows.set_id == named.node), "left")
        .withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id",
                F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")), "near_duplicates")

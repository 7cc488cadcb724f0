"""Exact top-k by inner product with a vector-approximation file.

1. Vectors become integers floor(``scale`` * x). Equal vectors are one class,
   which keeps its k + 1 smallest rows (no others can come into a result).
2. Each component is quantised to one of 256 cells; cell borders are quantiles
   of a sample of ``sample`` classes, the outer cells reach to the least and
   greatest component of all. The approximation file holds one byte a component.
3. Queries and approximations meet in blocks; a scan of the cells gives lower
   and upper bounds of each inner product, and only classes whose upper bound
   reaches the k-th lower bound of the query leave a block.
4. Exact vectors are read in order of upper bounds, round by round, until the
   k-th exact score is above all bounds that are left.

Nulls: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part. A vector shorter than the widest counts as ending
in zeros. Components are not bounded: they are kept as doubles, which hold every
floor exactly, and scores are summed as whole numbers of any size. Only a score
that does not fit a long is cut to the least or greatest long. Repeated rows are rows of their own: each is a query, and a
candidate of the others. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import packed, stack, vectors
from .store import stored

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _integers(scale: int):
    def run(batches):
        for b in batches:
            flat, offsets, ok = vectors(b.column("vector"))
            whole = np.nan_to_num(np.floor(np.nan_to_num(flat, posinf=0, neginf=0) * scale)) + 0.0    # no -0
            yield pa.RecordBatch.from_arrays([b.column("id"), packed(whole, offsets, ok, "<f8")], ["id", "vec"])
    return run


def _components(batches):
    """(at, least, most): per batch and component the range of values."""
    for b in batches:
        rows = b.column("vec").to_pylist()
        if rows:
            x = stack(rows, "<f8", max(len(r) for r in rows) // 8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(x.shape[1])), pa.array(x.min(0)), pa.array(x.max(0))],
                ["at", "least", "most"])


class Cells:
    """Cell borders of each component, and the middle and half width of cells."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        inner = np.quantile(sample, np.arange(1, 256) / 256, axis=0).T if len(sample) else np.zeros((len(least), 255))
        self.borders = np.clip(np.floor(inner), least[:, None], most[:, None] + 1)
        low = np.concatenate([least[:, None], self.borders], 1)
        high = np.maximum(low, np.concatenate([self.borders - 1, most[:, None]], 1))
        self.middle, self.half = low / 2 + high / 2, high / 2 - low / 2
        self.half += 1e-12 * (np.abs(self.middle) + self.half)    # more than the rounding of the sums

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for d, borders in enumerate(self.borders):
            out[:, d] = np.searchsorted(borders, x[:, d], "right")
        return out

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(codes.shape[1])
        return self.middle[at, codes], self.half[at, codes]


def _encode(cells: Cells, width: int):
    def run(batches):
        for b in batches:
            codes = cells.codes(stack(b.column("vec").to_pylist(), "<f8", width))
            yield pa.RecordBatch.from_arrays(
                [b.column("class"), pa.array([c.tobytes() for c in codes], pa.binary())], ["class", "code"])
    return run


def _scan(cells: Cells, width: int, k: int, tile: int):
    """One block of queries over one block of the approximation file."""
    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and codes.num_rows:
            q = stack(queries.column("vec").to_pylist(), "<f8", width)
            c = stack(codes.column("code").to_pylist(), "u1", width)
            ids, own = codes.column("class").to_numpy(), queries.column("class").to_numpy()
            middle, half = cells.ranges(c)
            for i in range(0, len(q), tile):
                x = q[i:i + tile]
                with np.errstate(over="ignore", invalid="ignore"):
                    centre, spread = x @ middle.T, np.abs(x) @ half.T
                    # sums beyond a double bound nothing; scores end where longs do
                    lower = np.clip(np.nan_to_num(centre - spread, nan=-np.inf, posinf=MOST, neginf=LEAST), LEAST, MOST)
                    upper = np.clip(np.nan_to_num(centre + spread, nan=np.inf, posinf=MOST, neginf=LEAST), LEAST, MOST)
                same = own[i:i + tile][:, None] == ids[None, :]
                lower[same] = -np.inf
                kth = np.partition(lower, -k, 1)[:, -k] if lower.shape[1] >= k else np.full(len(x), -np.inf)
                a, b = np.nonzero((upper >= kth[:, None]) & ~same)
                out.append((own[i + a], ids[b], lower[a, b], upper[a, b]))
        cols = [np.concatenate(p) for p in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table(cols, names=["query", "class", "lower", "upper"])
    return run


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner product of each two rows of whole numbers, cut to a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        small = ((np.abs(x) * np.abs(y)).sum(1) < 2.0 ** 62) & (np.abs(x) < 2.0 ** 63).all(1) & (np.abs(y) < 2.0 ** 63).all(1)
    out = np.empty(len(x), np.int64)
    out[small] = (x[small].astype(np.int64) * y[small].astype(np.int64)).sum(1)
    for i in np.flatnonzero(~small):
        out[i] = min(max(sum(int(a) * int(b) for a, b in zip(x[i], y[i])), LEAST), MOST)
    return out


def _exact(width: int):
    def run(batches):
        for b in batches:
            x, y = (stack(b.column(c).to_pylist(), "<f8", width) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays(
                [b.column("query"), b.column("class"), pa.array(_products(x, y))], ["query", "class", "score"])
    return run


def _score(pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    v = classes.select("class", "vec")
    return (pairs.select("query", "class")
            .join(v.select("class", F.col("vec").alias("y")), "class")
            .join(v.select(F.col("class").alias("query"), F.col("vec").alias("x")), "query")
            .mapInArrow(_exact(width), "query long, class long, score long"))


def _kth(rows: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """(query, name): the k-th greatest value of ``by``, for queries with as many."""
    w = Window.partitionBy("query").orderBy(F.desc(by), "class")
    return rows.withColumn("nth", F.row_number().over(w)).filter(f"nth <= {k}").filter(f"nth = {k}") \
        .select("query", F.col(by).alias(name))


def top_k(rows: DataFrame, id_column: str, vector_column: str, is_query, k: int = 10, scale: int = 1024,
          sample: int = 20_000, query_block: int = 4096, class_block: int = 16_384, tile: int = 128) -> DataFrame:
    """(query_id, rank, <id_column>, score): for each row where ``is_query`` (of
    column ``id``) holds, the k other rows of the greatest inner product.

    ``sample``: classes that cell borders are fitted on; ``query_block`` and
    ``class_block``: rows that meet in one task; ``tile``: queries scored at once."""
    whole = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).filter("id is not null")
    whole = stored(whole.mapInArrow(_integers(scale), "id long, vec binary").filter("vec is not null")
                   .withColumn("uid", F.monotonically_increasing_id()), "integers")
    first = Window.partitionBy("vec").orderBy("id", "uid")
    classes = stored(
        whole.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("id", "uid"))).alias("members"))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    hashed = classes.select(F.xxhash64("vec").alias("hash"), F.col("vec").alias("same"), "class")
    asked = whole.filter(is_query)
    asked = stored(asked.join(hashed, (F.xxhash64("vec") == F.col("hash")) & (F.col("vec") == F.col("same")))
                   .select("id", "uid", "class"), "queries")
    n, bytes_wide = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    width = (bytes_wide or 0) // 8
    # one row a component; the sample is bounded by its parameter
    ends = {r[0]: r[1:] for r in classes.select("vec").mapInArrow(_components, "at long, least double, most double")
            .groupBy("at").agg(F.min("least"), F.max("most")).take(width)}
    picked = [r[0] for r in classes.select("vec").orderBy(F.xxhash64("vec"), "vec").take(sample)]
    # components that shorter vectors lack count as zeros
    short = [0, 0] if any(len(v) < 8 * width for v in picked) or classes.filter(
        F.octet_length("vec") < 8 * width).limit(1).count() else None
    ranges = np.array([[min(ends[d][0], *(short or ends[d])), max(ends[d][1], *(short or ends[d]))]
                       for d in range(width)], float).reshape(width, 2)
    cells = Cells(stack(picked, "<f8", width), ranges[:, 0], ranges[:, 1])
    codes = stored(classes.select("class", "vec").mapInArrow(_encode(cells, width), "class long, code binary"), "approximations")
    queries = asked.select("class").distinct().join(classes.select("class", "vec"), "class")
    across = max(1, -(-n // class_block))
    down = max(1, -(-asked.select("class").distinct().count() // query_block))

    def spread(df, key, own, other, n_own, n_other):
        return (df.withColumn(own, F.pmod(F.xxhash64(F.lit(own), key), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    left = spread(queries, "class", "q", "c", down, across).groupBy("q", "c")
    right = spread(codes, "class", "c", "q", across, down).groupBy("q", "c")
    bounds = stored(left.cogroup(right).applyInArrow(
        _scan(cells, width, k, tile), "query long, class long, lower double, upper double"), "bounds")
    by_upper = Window.partitionBy("query").orderBy(F.desc("upper"), "class")
    left_over = stored(bounds.join(_kth(bounds, "lower", k, "least"), "query", "left")
                       .filter("least is null or upper >= least")
                       .select("query", "class", "upper", F.row_number().over(by_upper).alias("nth")), "candidates")
    upto, scored = 2 * k, None
    while True:
        part = stored(_score(left_over.filter(F.col("nth") <= upto), classes, width), "scores")
        scored = part if scored is None else scored.unionByName(part)
        certain = _kth(scored, "score", k, "kth")
        left_over = stored(left_over.filter(F.col("nth") > upto).join(certain, "query", "left")
                           .filter("kth is null or upper >= kth").drop("kth"), "candidates")
        if left_over.isEmpty():
            break
        upto *= 4
    itself = queries.select(F.col("class").alias("query"), "class")
    scored = scored.join(certain, "query", "left").filter("kth is null or score >= kth").drop("kth") \
        .unionByName(_score(itself, classes, width))
    # one more than k: the query's own row may be among them
    order = Window.partitionBy("query").orderBy(F.desc("score"), "member.id", "member.uid")
    best = (scored.join(classes.select("class", "members"), "class")
            .select("query", "score", F.explode("members").alias("member"))
            .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
            .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "member", "score"))).alias("best")))
    return (asked.join(best.withColumnRenamed("query", "class"), "class")
            .withColumn("best", F.slice(F.expr("filter(best, x -> x.member.uid <> uid)"), 1, k))
            .select(F.col("id").alias("query_id"), F.posexplode("best").alias("nth", "x"))
            .select("query_id", (F.col("nth") + 1).alias("rank"), F.col("x.member.id").alias(id_column), F.col("x.score").alias("score")))

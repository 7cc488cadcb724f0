"""Exact cosine top-k between a query table and a corpus table.

Plan shape (no cross join, nothing corpus-sized through the driver):

1. Both sides are hashed into blocks: queries into ``QB`` blocks, corpus into
   ``CB`` blocks. Query rows are replicated over the ``CB`` corpus blocks and
   corpus rows over the ``QB`` query blocks; each grid cell ``(qb, cb)`` is one
   partition, sorted so that its queries come first.
2. A cell holds its query block and streams its corpus block past it, by chunks:
   a single-precision product drops all that cannot reach the k best so far (by
   a bound on its rounding error); the rest is scored in double. What a cell
   holds is its queries, their k best hits and one chunk, whatever the corpus.
3. A final ``row_number() <= k`` window per query picks the global top-k; it
   is planned as a partial + final ``WindowGroupLimit``.

Block counts follow from the table sizes, so a cell's memory never grows with the
data and no single hot key exists (blocks are assigned by a hash of the id).

Ranking (T1: score descending, always with a key tie-break) is on the score
rounded half away from zero to ``decimals`` places, ties broken by an order
column (default: the corpus id), which keeps the result identical to the
SQL formulation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import DECIMALS, EPS
from ..session import ship_package

_OUT = T.StructType([
    T.StructField("_qid", T.LongType()),
    T.StructField("_grp", T.StringType()),
    T.StructField("_cid", T.LongType()),
    T.StructField("_ord", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def empty_frame(schema: T.StructType) -> pd.DataFrame:
    """Zero-row pandas frame with dtypes matching ``schema`` (untyped empty
    columns do not convert to Arrow)."""
    kinds = {T.LongType: "int64", T.IntegerType: "int32", T.DoubleType: "float64",
             T.FloatType: "float32", T.BooleanType: "bool"}
    return pd.DataFrame({f.name: pd.Series([], dtype=kinds.get(type(f.dataType), "object"))
                         for f in schema.fields})


def round_half_away(x: np.ndarray, decimals: int) -> np.ndarray:
    p = 10.0 ** decimals
    return np.sign(x) * np.floor(np.abs(x) * p + 0.5) / p


def _vectors(col: pa.Array, width: int | None) -> np.ndarray:
    widths = np.unique(np.diff(col.offsets.to_numpy()))
    if len(widths) > 1 or (width is not None and len(widths) and widths[0] != width):
        raise ValueError(f"vectors of different widths: {sorted({*widths.tolist()} | ({width} - {None}))[:5]}")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1 if len(widths) and widths[0] else 0)


def _normalise(m: np.ndarray, eps: float) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    return np.maximum(n, eps)


def _select(S: np.ndarray, k: int, dedup: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) index pairs that can be in the top-k of each row: every
    value at or above the row's k-th (distinct, when ``dedup``) value."""
    n, m = S.shape
    if m == 0 or n == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if dedup:
        srt = -np.sort(-S, axis=1)
        newv = np.ones_like(srt, dtype=bool)
        newv[:, 1:] = srt[:, 1:] != srt[:, :-1]
        newv &= np.isfinite(srt)
        cum = np.cumsum(newv, axis=1)
        reached = cum[:, -1] >= k
        pos = np.where(reached, np.argmax(cum >= k, axis=1), m - 1)
        thr = srt[np.arange(n), pos]
    else:
        kk = min(k, m)
        thr = -np.partition(-S, kk - 1, axis=1)[:, kk - 1]
    mask = (S >= thr[:, None]) & np.isfinite(S)
    return np.nonzero(mask)


#: numbers of a score block, corpus rows scored at once, hits a query block keeps
SCORES, CHUNK_ROWS, KEPT_HITS = 2_000_000, 4096, 2_000_000


class _Best:
    """The k best hits of each query of a block among the corpus rows of one
    group, which come in chunks."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, dedup: bool, exclude_self: bool, decimals: int):
        self.qids, self.q, self.q32 = qids, q, q.astype(np.float32)
        self.k, self.dedup, self.exclude_self, self.decimals = k, dedup, exclude_self, decimals
        # a rounded score, and a product of two vectors of length 1 at most in single precision
        self.margin = 0.51 * 10.0 ** -decimals + (q.shape[1] + 8) * 2.0 ** -23
        # the k-th best score, once there is one; a vector that is not finite has none
        self.least = np.where(np.isfinite(q).all(1), -np.inf, np.inf)
        self.hits: list[tuple] = []                 # (row, score, order, corpus id, payload columns)
        self.waiting = self.seen = self.cut_at = 0

    def add(self, cids: np.ndarray, ords: np.ndarray, c: np.ndarray, payload: list[pa.Array]) -> None:
        c32 = c.astype(np.float32)
        step = max(1, SCORES // max(len(c), 1))
        for s in range(0, len(self.q), step):
            least = self.least[s:s + step]
            if np.isneginf(least).any():
                S = round_half_away(self.q[s:s + step] @ c.T, self.decimals)
                if self.exclude_self:
                    S[self.qids[s:s + step, None] == cids[None, :]] = -np.inf
                r, j = _select(S, self.k, self.dedup)
                keep = S[r, j] >= least[r]
                r, j = r[keep], j[keep]
                score = S[r, j]
            else:
                # compared in single precision; the margin has room for the bound's own rounding
                bound = (least - self.margin).astype(np.float32)
                r, j = np.divmod(np.flatnonzero(self.q32[s:s + step] @ c32.T >= bound[:, None]), max(len(c), 1))
                score = np.empty(len(r))
                for i in range(0, len(r), 65536):
                    at = slice(i, i + 65536)
                    score[at] = np.einsum("ij,ij->i", self.q[s + r[at]], c[j[at]])
                score = round_half_away(score, self.decimals)
                keep = score >= least[r]
                if self.exclude_self:
                    keep &= self.qids[s + r] != cids[j]
                r, j, score = r[keep], j[keep], score[keep]
            if len(r):
                self.hits.append((s + r, score, ords[j], cids[j], [p.take(pa.array(j)) for p in payload]))
                self.waiting += len(r)
            if self.waiting > max(self.k * len(self.q), SCORES // 4):
                self.cut()
        self.seen += len(c)
        if self.seen >= self.cut_at and np.isneginf(self.least).any():
            self.cut()
            self.cut_at = 2 * self.seen

    def cut(self) -> None:
        """Leaves the k best of each query."""
        if not self.hits:
            return
        row, score, order, cid = (np.concatenate([h[i] for h in self.hits]) for i in range(4))
        at = np.lexsort((cid, order, -score, row))
        if self.dedup and len(at):
            new = np.r_[True, (row[at][1:] != row[at][:-1]) | (score[at][1:] != score[at][:-1])]
            at = at[new]
        rank = np.arange(len(at)) - np.searchsorted(row[at], row[at])
        at, rank = at[rank < self.k], rank[rank < self.k]
        payload = [pa.concat_arrays([h[4][i] for h in self.hits]).take(pa.array(at)) for i in range(len(self.hits[0][4]))]
        self.hits = [(row[at], score[at], order[at], cid[at], payload)]
        self.waiting = 0
        last = rank == self.k - 1
        self.least[row[at][last]] = score[at][last]


def _cell_topk(k: int, dedup: bool, exclude_self: bool, decimals: int, eps: float, names: list[str],
               q_pay: list[str], c_pay: list[str], quantize: str | None = None):
    def long(col: pa.Array) -> np.ndarray:
        return col.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)

    def unit(col: pa.Array, width: int | None) -> np.ndarray:
        m = _vectors(col, width)
        if quantize:
            m = m.astype(quantize).astype(np.float64)
        return m / _normalise(m, eps)[:, None]

    def run(batches):
        asked, queries, best, waiting = [], None, {}, []

        def score() -> None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            groups = t.column("_grp").to_pylist()
            for g in dict.fromkeys(groups):
                sub = t.filter(pa.array([x == g for x in groups])) if len({*groups}) > 1 else t
                sub = sub.combine_chunks().to_batches()[0]
                if g not in best:
                    best[g] = _Best(qids, vectors, k, dedup, exclude_self, decimals)
                best[g].add(long(sub.column("_id")), long(sub.column("_ord")), unit(sub.column("_v"), vectors.shape[1]),
                            [sub.column(p) for p in c_pay])
            waiting.clear()

        for b in (b.slice(i, CHUNK_ROWS) for b in batches for i in range(0, b.num_rows, CHUNK_ROWS)):
            n = int((b.column("side").to_numpy() == 0).sum())       # queries come first
            if n:
                asked.append(b.slice(0, n))
            b = b.slice(n)
            if b.num_rows and not asked:
                return
            if b.num_rows and queries is None:
                queries = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
                qids, vectors = long(queries.column("_id")), unit(queries.column("_v"), None)
                asked = [queries]
            if b.num_rows:
                waiting.append(b)
                if sum(w.num_rows for w in waiting) >= CHUNK_ROWS:
                    score()
        if waiting:
            score()
        for g, found in best.items():
            found.cut()
            for row, sc, order, cid, payload in found.hits:
                for i in range(0, len(row), 50_000):
                    at = slice(i, i + 50_000)
                    cols = {"_qid": pa.array(qids[row[at]]), "_grp": pa.array([g] * len(row[at]), pa.string()),
                            "_cid": pa.array(cid[at]), "_ord": pa.array(order[at]), "score": pa.array(sc[at])}
                    cols |= {p: queries.column(p).take(pa.array(row[at])) for p in q_pay}
                    cols |= {p: x.slice(i, 50_000) for p, x in zip(c_pay, payload)}
                    yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)
            found.hits = []
    return run


def grid(nq: int, nc: int, cells: int, dim: int, kept: int, qb_least: int, cb_least: int = 1) -> tuple[int, int]:
    """Grid shape (QB, CB) of at least ``cells`` cells (as far as there are rows) with
    the least bytes moved: vectors of both sides, and up to ``kept`` hits a query from each
    corpus block. Queries are split at least ``qb_least`` times, which bounds a cell's
    memory; a corpus block may be of any size, for it is streamed."""
    if nq <= 0 or nc <= 0:
        return max(qb_least, 1), max(cb_least, 1)
    row = 4 * dim + 32
    shapes = [(min(nq, max(qb_least, math.ceil(cells / cb))), cb) for cb in range(cb_least, max(cb_least, min(nc, cells)) + 1)]
    full = [s for s in shapes if s[0] * s[1] >= cells] or shapes[-1:]
    return min(full, key=lambda s: nc * s[0] * row + nq * s[1] * (row + 40 * min(kept, math.ceil(nc / s[1]))))


def block_counts(nq: int, nc: int, parallelism: int, q_max_rows: int, c_max_rows: int,
                 cells_per_core: int = 2, k: int = 1) -> tuple[int, int]:
    """Grid shape (QB, CB). Each block must fit its memory budget
    (``*_max_rows``); the grid has at least ``cells_per_core`` cells per
    core; among grids with that many cells the one with the least shuffle
    volume ``nq * CB + nc * QB`` is taken (QB / CB proportional to
    sqrt(nq / nc)). Replication therefore grows like sqrt(cells), not like
    rows / block size, and a small side ends up in a single block, which is
    the size-checked equivalent of a broadcast. A corpus block keeps at least
    ``4 k`` rows (unless memory forces smaller ones): each cell emits up to k
    candidates per query, so thinner blocks would not reduce anything; more
    query blocks make up the cell count instead."""
    qb = max(1, math.ceil(nq / max(q_max_rows, 1)))
    cb = max(1, math.ceil(nc / max(c_max_rows, 1)))
    if nq <= 0 or nc <= 0:
        return qb, cb
    cb_mem = cb
    target = max(qb * cb, cells_per_core * parallelism)
    qb = min(max(qb, round(math.sqrt(target * nq / nc))), nq)
    cb = min(max(cb, math.ceil(target / qb)), nc)
    cb_k = max(cb_mem, nc // max(4 * k, 1), 1)
    if cb > cb_k:
        cb = cb_k
        qb = min(max(qb, math.ceil(target / cb)), nq)
    return max(qb, 1), max(cb, 1)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, *,
                q_id: str, c_id: str, q_vec: str = "embedding", c_vec: str = "embedding",
                c_group: str | None = None, c_order: str | None = None,
                dedup_scores: bool = False, exclude_self: bool = False,
                decimals: int = DECIMALS, eps: float = EPS,
                block_bytes: int = 64 << 20,
                q_block_rows: int | None = None, c_block_rows: int | None = None,
                n_queries: int | None = None, n_corpus: int | None = None,
                q_payload: dict[str, str] | None = None,
                c_payload: dict[str, str] | None = None,
                quantize: str | None = None) -> DataFrame:
    """Top-k corpus rows per query (and per corpus group when ``c_group``)
    by cosine similarity.

    Output columns: ``q_id, [c_group], c_id, score, rank`` (rank 1-based).
    ``dedup_scores`` keeps only the first row (by order) of each exact
    rounded score before cutting at k. ``exclude_self`` drops pairs whose
    query id equals the corpus id (self-similarity search on one table).
    ``block_bytes`` of vectors, or ``q_block_rows``, is what a query block may
    hold; ``c_block_rows`` splits the corpus further, which memory does not need.
    ``q_payload`` / ``c_payload`` map query / corpus columns to output names:
    they travel with the rows through the grid and come out with each hit,
    so no join back to the (large) input tables is needed. Meant for small
    scalars (labels): candidates leave a cell once per corpus block, so
    vectors are cheaper to join back after the global cut.
    ``quantize="float16"`` rounds both sides to half precision before scoring
    (F13, the reference's storage precision); by default vectors are scored
    as stored (float) in double. Null vectors and vectors with null components
    take no part; vectors of different widths are an error.
    """
    spark = queries.sparkSession
    ship_package(spark)
    q_payload, c_payload = q_payload or {}, c_payload or {}
    qp = {src: f"_qp{i}" for i, src in enumerate(q_payload)}
    cp = {src: f"_cp{i}" for i, src in enumerate(c_payload)}
    q = queries.select(F.col(q_id).cast("long").alias("_qid"),
                       F.col(q_vec).cast("array<float>").alias("_qv"),
                       *[F.col(src).alias(tmp) for src, tmp in qp.items()])
    c = corpus.select(
        F.col(c_id).cast("long").alias("_cid"),
        F.col(c_vec).cast("array<float>").alias("_cv"),
        (F.col(c_group).cast("string") if c_group else F.lit("")).alias("_grp"),
        (F.col(c_order).cast("long") if c_order else F.col(c_id).cast("long")).alias("_ord"),
        *[F.col(src).alias(tmp) for src, tmp in cp.items()],
    )
    out_schema = T.StructType(_OUT.fields + [q.schema[t] for t in qp.values()]
                              + [c.schema[t] for t in cp.values()])
    # a null vector, or one with a null component, has no similarity to anything
    q, c = (side.filter(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())) for side, v in ((q, "_qv"), (c, "_cv")))
    # sizes and vector width in one cheap aggregate per side
    sides = (q.select(F.lit(0).alias("side"), F.size("_qv").alias("d"), F.lit(None).cast("string").alias("g"))
             .unionByName(c.select(F.lit(1).alias("side"), F.size("_cv").alias("d"), F.coalesce("_grp", F.lit("")).alias("g"))))
    st = sides.agg(F.count(F.when(F.col("side") == 0, 1)).alias("nq"),
                   F.count(F.when(F.col("side") == 1, 1)).alias("nc"),
                   F.max("d").alias("d"), F.approx_count_distinct("g").alias("groups")).first()          # one small job, one row back
    nq = n_queries if n_queries is not None else st["nq"]
    nc = n_corpus if n_corpus is not None else st["nc"]
    dim = max(st["d"] or 1, 1)
    kept = max(k, 1) * max(st["groups"], 1)
    # all groups' hits of a block, of which one group is sorted at a time
    rows_budget = max(1, min(block_bytes // (8 * dim), 2 * KEPT_HITS // kept))
    cells = 2 * spark.sparkContext.defaultParallelism
    QB, CB = grid(nq, nc, cells, dim, kept, math.ceil(nq / (q_block_rows or rows_budget)),
                  math.ceil(nc / c_block_rows) if c_block_rows else 1)

    def block(n: int):
        return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")

    q_rep = (q.withColumnsRenamed({"_qid": "_id", "_qv": "_v"}).withColumn("side", F.lit(0))
             .withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(CB - 1)), lambda cb: block(QB) * CB + cb))))
    c_rep = (c.withColumnsRenamed({"_cid": "_id", "_cv": "_v"}).withColumn("side", F.lit(1))
             .withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(QB - 1)), lambda qb: qb * CB + block(CB)))))
    cells = (q_rep.unionByName(c_rep, allowMissingColumns=True).repartitionById(QB * CB, F.col("cell")).sortWithinPartitions("side")
             .mapInArrow(_cell_topk(k, dedup_scores, exclude_self, decimals, eps, out_schema.names,
                                    list(qp.values()), list(cp.values()), quantize), out_schema))

    w = Window.partitionBy("_qid", "_grp").orderBy(F.desc("score"), "_ord", "_cid")
    if dedup_scores:
        # equal scores are neighbours in ranking order: one shuffle for both windows
        cells = cells.withColumn("_before", F.lag("score").over(w)).filter("_before is null or _before <> score").drop("_before")
    ranked = cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    cols = [F.col("_qid").alias(q_id)]
    if c_group:
        cols.append(F.col("_grp").alias(c_group))
    cols += [F.col("_cid").alias(c_id if c_id != q_id else f"{c_id}_hit"),
             F.col("score"), F.col("rank").cast("long").alias("rank")]
    cols += [F.col(tmp).alias(q_payload[src]) for src, tmp in qp.items()]
    cols += [F.col(tmp).alias(c_payload[src]) for src, tmp in cp.items()]
    return ranked.select(*cols)

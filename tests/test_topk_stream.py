"""The cells of the top-k grid hold their queries and k hits, however long the corpus is."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdict.operators import topk
from verdict.operators.topk import _Best, _cell_topk, grid, round_half_away, vector_topk


def _batches(q, c, groups):
    n = len(q) + len(c)
    t = pa.table({
        "_id": pa.array([*range(len(q)), *range(len(c))], pa.int64()), "_v": pa.array([*q.tolist(), *c.tolist()], pa.list_(pa.float64())),
        "side": pa.array([0] * len(q) + [1] * len(c), pa.int32()), "_grp": pa.array([None] * len(q) + groups, pa.string()),
        "_ord": pa.array([*range(len(q)), *range(len(c))], pa.int64()), "_cp0": pa.array([f"p{i}" for i in range(n)])})
    return t.to_batches(max_chunksize=37)


@pytest.mark.parametrize("dedup", [False, True])
def test_cell_streams_its_corpus(monkeypatch, dedup):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(23, 6)), rng.normal(size=(700, 6))
    c[300:340] = c[:40]                                        # ties
    q[3] = np.nan
    groups = [["a", "b", None][i % 3] for i in range(len(c))]
    names = ["_qid", "_grp", "_cid", "_ord", "score", "_cp0"]
    got = pa.Table.from_batches(_cell_topk(5, dedup, True, 6, 1e-6, names, [], ["_cp0"])(iter(_batches(q, c, groups)))).to_pylist()
    unit = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    S = round_half_away(unit(q) @ unit(c).T, 6)
    for g in ("a", "b", None):
        for i in range(len(q)):
            want, seen = [], set()
            for s, j in sorted((-S[i, j], j) for j in range(len(c)) if groups[j] == g and j != i and np.isfinite(S[i, j])):
                if not (dedup and s in seen):
                    want.append((j, -s, f"p{len(q) + j}"))
                seen.add(s)
            mine = [(r["_cid"], r["score"], r["_cp0"]) for r in got if r["_qid"] == i and r["_grp"] == g]
            assert mine == want[:5], (g, i)


def test_hits_held_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(6)
    q = rng.normal(size=(50, 8))
    best, held = _Best(np.arange(50), q, 4, False, True, 6), []
    for i in range(40):
        c = rng.normal(size=(200, 8))
        best.add(np.arange(200) + 200 * i, np.arange(200), c, [])
        best.cut()
        held.append(sum(len(h[0]) for h in best.hits))
    assert held == [200] * 40
    # queries of one block are fewer the more hits each keeps
    qb, _ = grid(600_000, 600_000, 24, 64, 200, -(-600_000 // 20_000))
    assert 600_000 / qb * 200 <= 4_000_000


def test_ids_may_repeat(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.7, 0.7])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = vector_topk(df.select(F.col("id").alias("query_id"), "embedding"), df.select(F.col("id").alias("corpus_id"), "embedding"), 5,
                      q_id="query_id", c_id="corpus_id", exclude_self=True).collect()
    assert sorted((r.query_id, r.corpus_id) for r in got) == sorted((a, b) for a, _ in rows for b, _ in rows if a != b)

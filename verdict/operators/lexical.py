"""Lexical pair scorer (R4): idf-weighted token overlap between claims and
documents, exact top-k documents per claim.

score(claim, doc) = sum over distinct tokens shared by both of
ln(N / df(token)), N = number of documents. Only pairs sharing a token are
candidates.

Plan: tokenisation, document frequencies and idf are Spark aggregates. A
token join would emit every (claim, doc) pair of every frequent token, so
the scoring instead runs on the block grid of ``topk`` (claims x document
blocks, replicated by hash, ``cogroup`` per cell): inside a cell the claim
block's idf weights form a (vocab x claims) matrix and each chunk of
documents a (docs x vocab) incidence matrix; one matrix product gives the
scores and only the top-k per claim leave the cell.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import distinct_tokens
from ..session import ship_package, spread
from .topk import block_counts, empty_frame, round_half_away

_OUT = T.StructType([T.StructField("_qid", T.LongType()), T.StructField("_did", T.LongType()),
                     T.StructField("score", T.DoubleType())])


def _cell(k: int, decimals: int, budget: int = 4_000_000):
    def fn(qdf: pd.DataFrame, ddf: pd.DataFrame) -> pd.DataFrame:
        if len(qdf) == 0 or len(ddf) == 0:
            return empty_frame(_OUT)
        qids = qdf["_qid"].to_numpy(np.int64)
        # claim block vocabulary and weights
        ct = pd.DataFrame({"q": np.repeat(np.arange(len(qdf)), qdf["_tok"].map(len).to_numpy()),
                           "t": np.concatenate([np.asarray(x, dtype=object) for x in qdf["_tok"]])
                           if len(qdf) else [],
                           "w": np.concatenate([np.asarray(x, dtype=np.float64) for x in qdf["_idf"]])
                           if len(qdf) else []})
        vocab = pd.Index(ct["t"].unique())
        V = len(vocab)
        if V == 0:
            return empty_frame(_OUT)
        W = np.zeros((V, len(qdf)))
        B = np.zeros((V, len(qdf)))
        vi = vocab.get_indexer(ct["t"])
        W[vi, ct["q"].to_numpy()] = ct["w"].to_numpy()
        B[vi, ct["q"].to_numpy()] = 1.0
        dids = ddf["_did"].to_numpy(np.int64)
        toks = ddf["_tok"].to_numpy()
        chunk = max(1, budget // V)
        out = []
        for s in range(0, len(dids), chunk):
            sub = toks[s:s + chunk]
            lens = np.fromiter((len(x) for x in sub), dtype=np.int64, count=len(sub))
            if lens.sum() == 0:
                continue
            flat = np.concatenate([np.asarray(x, dtype=object) for x in sub])
            rows = np.repeat(np.arange(len(sub)), lens)
            cols = vocab.get_indexer(flat)
            keep = cols >= 0
            D = np.zeros((len(sub), V))
            D[rows[keep], cols[keep]] = 1.0
            S = round_half_away((D @ W).T, decimals)          # claims x docs
            C = (D @ B).T
            S[C <= 0] = -np.inf
            kk = min(k, S.shape[1])
            thr = -np.partition(-S, kk - 1, axis=1)[:, kk - 1]
            r, c = np.nonzero((S >= thr[:, None]) & np.isfinite(S))
            if len(r):
                out.append(pd.DataFrame({"_qid": qids[r], "_did": dids[s:s + chunk][c], "score": S[r, c]}))
        if not out:
            return empty_frame(_OUT)
        res = pd.concat(out, ignore_index=True).sort_values(["_qid", "score", "_did"],
                                                            ascending=[True, False, True])
        return res.groupby("_qid", sort=False).head(k)[[f.name for f in _OUT.fields]]
    return fn


def lexical_topk(claims: DataFrame, docs: DataFrame, k: int, *, claim_id: str, claim_text: str,
                 doc_id: str, doc_text: str, decimals: int = 6, q_block_rows: int | None = None,
                 d_block_rows: int | None = None, block_tokens: int = 4_000_000,
                 claim_block_tokens: int = 50_000) -> DataFrame:
    """Top-k documents per claim: ``claim_id, doc_id, score, rank``.

    Block sizes follow from token budgets: a document block holds at most
    about ``block_tokens`` (document, token) entries and a claim block a
    vocabulary of about ``claim_block_tokens`` (it sets the width of the
    in-cell matrices), estimated from the average text length per row."""
    spark = claims.sparkSession
    ship_package(spark)
    dt = spread(docs.select(doc_id, doc_text)).select(
        F.col(doc_id).cast("long").alias("_did"), distinct_tokens(F.col(doc_text)).alias("_tok"))
    n_docs = docs.select(F.count("*").cast("double")).scalar()
    idf = (dt.select(F.explode("_tok").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
           .select("t", F.log(n_docs / F.col("df")).alias("idf")))
    ct = claims.select(F.col(claim_id).cast("long").alias("_qid"),
                       F.explode(distinct_tokens(F.col(claim_text))).alias("t"))
    cw = (ct.join(idf, "t").groupBy("_qid")
          .agg(F.collect_list("t").alias("_tok"), F.collect_list("idf").alias("_idf")))
    # grid sizing: row counts and average text length per row (one cheap
    # aggregate per side, no tokenising pass); a token is taken as >= 6
    # characters on average, which over-estimates tokens, so blocks err small
    qs = claims.agg(F.count("*").alias("n"), F.avg(F.length(claim_text)).alias("c")).first()
    ds = docs.agg(F.count("*").alias("n"), F.avg(F.length(doc_text)).alias("c")).first()
    nq, nd = qs["n"], ds["n"]
    q_tok, d_tok = max((qs["c"] or 6.0) / 6.0, 1.0), max((ds["c"] or 6.0) / 6.0, 1.0)
    q_rows = q_block_rows or max(1, int(claim_block_tokens // q_tok))
    d_rows = d_block_rows or max(1, int(block_tokens // d_tok))
    QB, CB = block_counts(nq, nd, spark.sparkContext.defaultParallelism, q_rows, d_rows)
    q_rep = (cw.withColumn("qb", F.pmod(F.xxhash64("_qid"), F.lit(QB)).cast("int"))
             .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(CB - 1)))))
    d_rep = (dt.withColumn("cb", F.pmod(F.xxhash64("_did"), F.lit(CB)).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(QB - 1)))))
    cells = (q_rep.groupBy("qb", "cb").cogroup(d_rep.groupBy("qb", "cb"))
             .applyInPandas(_cell(k, decimals), _OUT))
    w = Window.partitionBy("_qid").orderBy(F.desc("score"), "_did")
    r = cells.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return r.select(F.col("_qid").alias(claim_id), F.col("_did").alias(doc_id), "score", "rank")

"""Batch scorers for the X2 hook (pandas batch in, pandas batch out).

Kept free of Spark imports so executors load them cheaply.
"""

from __future__ import annotations

import re

import pandas as pd

_WS = re.compile(r"[^ \t\n\r\f]+")


def token_count_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a model scorer: whitespace token count."""
    n = pdf["text"].map(lambda s: len(_WS.findall(s)) if isinstance(s, str) else None)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n.astype("Int64")})

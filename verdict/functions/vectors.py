"""Vector and probability expressions over ``array<float|double>`` columns.

All arithmetic is done in double; scores are rounded to ``DECIMALS`` before
ranking so that ties are defined on a stable value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMALS = 6
EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, eps: float = EPS) -> Column:
    """x.y / (max(|x|, eps) * max(|y|, eps))."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def dims(a, start: int, length: int) -> Column:
    """1-based slice of a vector."""
    return F.slice(_c(a), start, length)


def softmax(a) -> Column:
    """Numerically stable softmax of a logit array, in double; null -> null."""
    a = _c(a)
    m = F.array_max(a).cast("double")
    ex = F.transform(a, lambda x: F.exp(x.cast("double") - m))
    s = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def argmax(a) -> Column:
    """0-based index of the first maximum (a tie goes to the lowest index)."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def array_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double"))


def rounded(c, decimals: int = DECIMALS) -> Column:
    return F.round(_c(c), decimals)

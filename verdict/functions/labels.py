"""Label expressions: vocabulary maps (P5-P8), the four-path fold (F9),
missing prediction -> NEI (P21) and free-text answer parsing (P11, P12).

Maps are literal ``CASE``/``create_map`` expressions over the fixed
vocabularies in ``schemas``: no join, no UDF.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (ANSWER_MARKER, CATEGORIES, CATEGORY_PATH_LABELS, SIMPLE_CLASSES,
                       SIMPLIFIED, UNKNOWN_LABELS_CATEGORY, UNKNOWN_PATH_LABELS)

SUPPORT, NEI, REFUTE = "support", "not_enough_information", "refute"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def category_code(cat) -> Column:
    """5-class name -> code 0..4 (main vocabulary), null when unknown."""
    return _map({c: i for i, c in enumerate(CATEGORIES)})[_c(cat)]


def category_name(code) -> Column:
    return _map(dict(enumerate(CATEGORIES)))[_c(code)]


def expand_category(cat) -> Column:
    """P5: category -> array of 4 path labels; unknown -> 1,1,1,1."""
    m = F.create_map(*chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in CATEGORY_PATH_LABELS.items()))
    return F.coalesce(m[_c(cat)], F.array(*[F.lit(x) for x in UNKNOWN_PATH_LABELS]))


def labels_key(labels) -> Column:
    return F.concat_ws(",", F.transform(_c(labels), lambda x: x.cast("string")))


def collapse_labels(labels) -> Column:
    """4 path labels -> category; unknown vector -> Insufficient_Text."""
    m = _map({",".join(map(str, v)): k for k, v in CATEGORY_PATH_LABELS.items()})
    return F.coalesce(m[labels_key(labels)], F.lit(UNKNOWN_LABELS_CATEGORY))


def simplify(cat) -> Column:
    """5-class name -> 3-class name."""
    return _map(SIMPLIFIED)[_c(cat)]


def simple_code(name) -> Column:
    return _map({c: i for i, c in enumerate(SIMPLE_CLASSES)})[_c(name)]


def verdict_of_code(code) -> Column:
    """0 support, 1 not_enough_information, 2 refute."""
    return _map({0: SUPPORT, 1: NEI, 2: REFUTE})[_c(code)]


def or_nei(pred) -> Column:
    """A missing path prediction counts as not_enough_information."""
    return F.coalesce(_c(pred), F.lit(NEI))


def _resolve(a: Column, b: Column) -> Column:
    decided = [SUPPORT, REFUTE]
    return (F.when((a == b) & a.isin(decided), a)
            .when(a.isin(decided) & (b == NEI), a)
            .when(b.isin(decided) & (a == NEI), b)
            .otherwise(F.lit(NEI)))


def fold_paths(tt, ti, it, ii) -> Column:
    """resolve(text_text, image_image); if undecided resolve(text_image,
    image_text); else not_enough_information. A resolve agrees on a decided
    label, or takes the decided one when the other is NEI."""
    tt, ti, it, ii = (or_nei(_c(x)) for x in (tt, ti, it, ii))
    first = _resolve(tt, ii)
    return F.when(first != NEI, first).otherwise(_resolve(ti, it))


def strip_ws(s) -> Column:
    """Python-style strip: trim also tabs and newlines (``trim`` keeps them)."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def parse_answer_label(text) -> Column:
    """Last line of the stripped answer, lower-cased; contains
    ``support`` -> 0, else ``refute`` or ``false`` -> 2, else 1."""
    last = F.lower(F.element_at(F.split(strip_ws(text), "\n"), -1))
    return (F.when(last.contains("support"), 0)
            .when(last.contains("refute") | last.contains("false"), 2)
            .otherwise(1))


def has_marker(text) -> Column:
    return _c(text).contains(ANSWER_MARKER)


def after_marker(text) -> Column:
    """The text between the first and the second marker, stripped and
    lower-cased (``split(marker)[1]``)."""
    part = F.get(F.split(_c(text), F.lit("\\Q" + ANSWER_MARKER + "\\E"), -1), 1)
    return F.lower(strip_ws(part))

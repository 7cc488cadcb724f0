"""Property-based checks of the metric core against a pure-Python model."""

from hypothesis import given, settings
from hypothesis import strategies as st

from verdict.operators.metrics import report

pairs = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40)


def _model(rows):
    classes = sorted({y for y, _ in rows} | {p for _, p in rows})
    n = len(rows)
    out = {}
    f1s, ws = [], 0.0
    for c in classes:
        tp = sum(1 for y, p in rows if y == c and p == c)
        sup = sum(1 for y, _ in rows if y == c)
        npr = sum(1 for _, p in rows if p == c)
        f1 = 2 * tp / (sup + npr) if sup + npr else 0.0
        f1s.append(f1)
        ws += sup * f1
    out["accuracy"] = sum(1 for y, p in rows if y == p) / n
    out["macro_f1"] = sum(f1s) / len(f1s)
    out["weighted_f1"] = ws / n
    return out


@settings(max_examples=8, deadline=None)
@given(pairs)
def test_report_matches_model(spark, rows):
    df = spark.createDataFrame(rows, "y int, p int")
    got = {r.metric: r.value for r in report(df, "y", "p").collect() if r.cls == "all"}
    exp = _model(rows)
    for k, v in exp.items():
        assert abs(got[k] - round(v, 6)) < 1e-9, (k, got[k], v)
    assert got["micro_f1"] == got["accuracy"]

"""Answer scoring from token logits (F3, F4a, F4b, F5, F6) and the three
re-rank formulas (F7a, F7b, F7c). Pure column expressions over an
``array<float>`` logit column and answer / score columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _weights(logits: Column) -> Column:
    """exp(z - max z) for a whole logit array, in double."""
    return _let(F.struct(logits.alias("z"), F.array_max(logits).cast("double").alias("m")),
                lambda s: F.transform(s["z"], lambda z: F.exp(z.cast("double") - s["m"])))


def _with_total(weights: Column, body) -> Column:
    """``body(struct(w, t))`` with the weights and their sum."""
    return _let(weights, lambda w: _let(
        F.struct(w.alias("w"), F.aggregate(w, F.lit(0.0), lambda a, v: a + v).alias("t")), body))


def _pick(labels: list[str], scores: list[Column]) -> Column:
    """Max score, the first listed label on a tie (torch.max)."""
    best = F.greatest(*scores)
    lab = F.lit(labels[-1])
    for name, s in reversed(list(zip(labels[:-1], scores[:-1]))):
        lab = F.when(s == best, F.lit(name)).otherwise(lab)
    return F.struct(lab.alias("label"), best.alias("score"))


def group_answer(logits: Column, groups: dict[str, list[int]], *, whole: bool = False,
                 other: str | None = None) -> Column:
    """softmax over the listed answer tokens only, summed per answer
    group; F4a/F4b (``whole``): softmax over the whole array, whatever its
    length, summed per group, plus ``other = 1 - sum`` when ``other`` names
    it. Positions are 1-based. Returns ``struct(label, score)`` of the
    largest group."""
    places = [p for ps in groups.values() for p in ps]
    at = {p: p if whole else i + 1 for i, p in enumerate(places)}
    taken = logits if whole else F.array(*[F.element_at(logits, p) for p in places])

    def answer(s: Column) -> Column:
        sums = [sum((F.element_at(s["w"], at[p]) for p in ps[1:]), F.element_at(s["w"], at[ps[0]])) / s["t"]
                for ps in groups.values()]
        rest = [F.lit(1.0) - sum(sums[1:], sums[0])] if other is not None else []
        return F.array(*sums, *rest)

    labels = [*groups, *([other] if other is not None else [])]
    return _let(_with_total(_weights(taken), answer),
                lambda a: _pick(labels, [F.element_at(a, i + 1) for i in range(len(labels))]))


def generated_token_prob(logits: Column) -> Column:
    """greedy token (first argmax, 0-based) and its probability under a
    softmax over the whole array."""
    tok = (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
    return F.struct(tok.alias("token"),
                    _with_total(_weights(logits), lambda s: F.array_max(s["w"]) / s["t"]).alias("prob"))


def rerank_yes_flag(answer: Column, first_stage: Column) -> Column:
    """(1 if lower(answer) == 'yes' else 0.0001) * first-stage score."""
    return F.when(F.lower(answer) == "yes", F.lit(1.0)).otherwise(F.lit(0.0001)) * first_stage


def rerank_score3(answer: Column, s: Column) -> Column:
    """The chance of yes, by answer. A yes has its score (a negative one
    counts from 1 down), a no what its score leaves of 1 at a weight of 0.00001,
    other answers nothing."""
    return (F.when((answer == "yes") & (s >= 0), s).when(answer == "yes", s + 1)
            .when((answer == "no") & (s > 0), (1 - s) * 0.00001).when(answer == "no", s * -0.00001)
            .otherwise(F.lit(0.0)))


def rerank_score2(answer: Column, s: Column) -> Column:
    """As F7b with every other answer as a no; a yes with score 0 has 1."""
    return (F.when((answer == "yes") & (s > 0), s).when(answer == "yes", s + 1)
            .when(s >= 0, (1 - s) * 0.00001).otherwise(s * -0.00001))

"""Language identification job (R5), standing in for a per-row detector.

Model: character-trigram counts per language from a labelled table.
Score of a text for a language that shares at least one trigram with it:
sum_t n(t) * ln((c(t, lang) + 1) / (N_lang + V)), add-one smoothing over the
trigram vocabulary V; the text gets the best-scoring language (ties by
language code), a text without trigrams, such as a
blank one, gets ``unknown``. The reported
score is the mean log-probability per trigram, rounded to 6.

Plan: trigrams come from one linear regex pass per text. The model counts
(trigram, language) straight from the exploded trigrams, combined map side,
so only the small model is shuffled; it is checkpointed once because it
feeds both the vocabulary size and the scoring join. Scoring looks up each
trigram of a text where the text is: the model's most frequent trigrams, one row
each with a count per language, are a broadcast join, and a text's sums are combined
map side, so a few rows a text are shuffled. Trigrams beyond that number are counted per
document and joined on the trigram; they are the rare ones.
Trigram totals per document and per language need no trigram pass at all:
a stripped text of L code points has max(L - 2, 0) trigrams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams
from ..session import cut_lineage


def stripped(text_col: str):
    """The lower-cased text without white space at its ends."""
    return F.btrim(F.lower(F.col(text_col)), F.lit(" \t\n\x0b\f\r"))


def n_trigrams(text_col: str):
    return F.greatest(F.length(stripped(text_col)) - 2, F.lit(0)).cast("long")


def trigram_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    g = df.select(id_col, *keep, F.explode(char_ngrams(stripped(text_col), 3)).alias("tri"))
    return g.groupBy(id_col, *keep, "tri").agg(F.count("*").alias("n"))


def train(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str,
          counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (model ``tri, lang, c``, totals ``lang, log_den``).
    ``counts`` (``id, lang, tri, n``) reuses trigram counts already made."""
    if counts is not None:
        model = counts.groupBy("tri", F.col(lang_col).alias("lang")).agg(F.sum("n").alias("c"))
    else:
        # straight from the exploded trigrams: (trigram, language) counts
        # combine map side, so only the small model is shuffled, not the
        # per-document counts
        ex = labelled.select(F.col(lang_col).alias("lang"),
                             F.explode(char_ngrams(stripped(text_col), 3)).alias("tri"))
        model = ex.groupBy("tri", "lang").agg(F.count("*").alias("c"))
    # the model (one row per trigram and language, bounded by the trigram
    # vocabulary) feeds the vocabulary size and the scoring join: materialise
    # it once in the shared checkpoint folder
    model = cut_lineage(model)
    vocab = model.select(F.countDistinct("tri").cast("double")).scalar()
    totals = (labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(n_trigrams(text_col)).alias("N"))
              .select("lang", F.log(F.col("N").cast("double") + vocab).alias("log_den")))
    return model, totals


#: trigrams of the broadcast part of the model
FREQUENT = 200_000


def _sums(found: DataFrame, id_col: str) -> DataFrame:
    """(id, lang, num) from rows ``(id, n, of)``, ``of`` the (lang, c) of a trigram."""
    return (found.select(id_col, "n", F.inline("of")).groupBy(id_col, "lang")
            .agg(F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("num")))


def detect(texts: DataFrame, model: DataFrame, totals: DataFrame, *, id_col: str, text_col: str,
           counts: DataFrame | None = None, frequent: int = FREQUENT) -> DataFrame:
    by_tri = model.groupBy("tri").agg(F.sum("c").alias("all"), F.collect_list(F.struct("lang", "c")).alias("of"))
    if counts is not None:
        s = _sums(counts.select(id_col, "tri", "n").join(by_tri, "tri"), id_col)
    else:
        # the most frequent ones, ties cut anywhere: either part holds a trigram whole
        by_tri = cut_lineage(by_tri)
        many = by_tri.count() > frequent
        common = cut_lineage(by_tri.orderBy(F.desc("all")).limit(frequent)) if many else by_tri
        tris = texts.select(id_col, F.explode(char_ngrams(stripped(text_col), 3)).alias("tri")).withColumn("n", F.lit(1))
        s = _sums(tris.join(F.broadcast(common.select("tri", "of")), "tri"), id_col)
        if many:
            others = tris.join(F.broadcast(common.select("tri")), "tri", "left_anti").groupBy(id_col, "tri").agg(F.count("*").alias("n"))
            rare = by_tri.join(F.broadcast(common.select("tri")), "tri", "left_anti")
            s = (s.unionByName(_sums(others.join(rare, "tri"), id_col))
                 .groupBy(id_col, "lang").agg(F.sum("num").alias("num")))
    n_doc = texts.select(id_col, n_trigrams(text_col).alias("n_doc"))
    s = s.join(totals, "lang").join(n_doc, id_col) \
        .withColumn("score", F.col("num") - F.col("n_doc") * F.col("log_den"))
    best = s.groupBy(id_col).agg(F.min_by(F.struct("lang", "score", "n_doc"),
                                          F.struct(F.negative(F.round("score", 6)), F.col("lang"))).alias("b"))
    out = texts.select(id_col).join(best, id_col, "left")
    return out.select(id_col, F.coalesce("b.lang", F.lit("unknown")).alias("lang_pred"),
                      F.round(F.col("b.score") / F.col("b.n_doc"), 6).alias("score"))

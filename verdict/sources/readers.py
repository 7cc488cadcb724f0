"""Readers for the reference's tables, re-expressed as Spark scans.

All schemas are declared; a missing path fails (Spark's default). Column
subsets are selected right after the scan so pruning reaches the file
reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CANDIDATES, IMAGE_CORPUS, QRELS, RAW_CLAIMS, TEXT_CORPUS
from .quoted import read_quoted


def read_claims_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW_CLAIMS) -> DataFrame:
    """Tab-separated, one header row skipped, names imposed; quoted
    fields may hold tabs, quotes (doubled) and newlines. Many tasks read a file."""
    return read_quoted(spark, path, schema, sep="\t", mode="FAILFAST")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """A preprocessed table; ``columns`` is pushed into the scan
    (P2 column pruning: only those columns are read). A csv file with a schema is read by
    many tasks; without one Spark takes the names of its header, one task a file."""
    if fmt == "csv" and schema is not None:
        df = read_quoted(spark, path, schema)
    else:
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        if fmt == "csv":
            r = r.option("header", True).option("multiLine", True).option("escape", '"')
        df = r.load(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """Vector corpora in parquet. An empty folder yields an empty
    DataFrame with the declared schema instead of an error."""
    schema = TEXT_CORPUS if kind == "text" else IMAGE_CORPUS
    return spark.read.schema(schema).parquet(path)


def read_qrels(spark: SparkSession, path: str, level: str = "RELEVANCY") -> DataFrame:
    """Judgements; ``level`` chooses RELEVANCY or evidence_relevant;
    value 1 is positive, anything else negative."""
    return judgements(spark.read.schema(QRELS).option("header", True).csv(path), level)


def judgements(qrels: DataFrame, level: str = "RELEVANCY") -> DataFrame:
    """S7 on a table of judgements: ``query_id, doc_id, positive`` at one level;
    a null judgement is negative."""
    return qrels.select(F.col("TOPIC").alias("query_id"), F.col("DOCUMENT#").alias("doc_id"),
                        F.coalesce(F.col(level) == 1, F.lit(False)).alias("positive"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """S9 + P14: passages keyed ``claim-doc-paragraph`` with trimmed text."""
    schema = T.StructType([T.StructField("claim_id", T.LongType()),
                           T.StructField("relevant_document_id", T.LongType()),
                           T.StructField("paragraph_id", T.LongType()),
                           T.StructField("paragraph", T.StringType())])
    df = read_quoted(spark, path, schema)
    return df.select(F.concat_ws("-", "claim_id", "relevant_document_id", "paragraph_id").alias("key"),
                     F.regexp_replace("paragraph", r"^\s+|\s+$", "").alias("text"))


def list_images(spark: SparkSession, folder: str, glob: str = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}") -> DataFrame:
    """Image listing; only the path is selected, so the binary
    content column is pruned from the scan."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(folder).select("path"))


def read_candidates(spark: SparkSession, path: str, image_dir: str | None = None) -> DataFrame:
    """External ranked candidates ``(query_id, corpus_id, score)``,
    with the image path attached when ``image_dir`` is given."""
    df = spark.read.schema(CANDIDATES).parquet(path)
    if image_dir:
        df = df.withColumn("corpus_path", F.concat(F.lit(image_dir.rstrip("/") + "/"), F.col("corpus_id")))
    return df


def read_model_probs(spark: SparkSession, paths: list[str], n_classes: int = 5) -> DataFrame:
    """S13 + J13: per-model probability tables keyed by id, brought together by key
    (never by position) into ``id, m1, m2, m3``: one aggregate over all of them, combined
    map side. An id that a model misses or repeats, or has no id, fails the read."""
    models = [f"m{i}" for i in range(1, len(paths) + 1)]
    schema = T.StructType([T.StructField("id", T.LongType())]
                          + [T.StructField(f"p{c}", T.DoubleType()) for c in range(n_classes)])
    rows = None
    for name, p in zip(models, paths):
        df = spark.read.schema(schema).option("header", True).csv(p).select(
            "id", F.lit(name).alias("model"), F.array(*[f"p{c}" for c in range(n_classes)]).alias("probs"))
        rows = df if rows is None else rows.unionByName(df)
    of = [F.when(F.col("model") == m, F.col("probs")) for m in models]
    together = rows.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(m) for m, c in zip(models, of)],
                                      F.array(*[F.count(c) for c in of]).alias("_n"))
    whole = F.col("id").isNotNull() & F.forall("_n", lambda n: n == 1)
    wrong = F.raise_error(F.concat(F.lit("models without, or with several, rows of id "),
                                   F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return together.select(F.when(whole, F.col("id")).otherwise(wrong.cast("long")).alias("id"), *models)


SAMPLES = T.StructType([
    T.StructField("idx", T.LongType(), False),
    T.StructField("claim", T.StringType(), True),
    T.StructField("document", T.StringType(), True),
    T.StructField("claim_image", T.StringType(), True),
    T.StructField("document_image", T.StringType(), True),
    T.StructField("labels", T.ArrayType(T.IntegerType()), True),
])


def read_samples(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The training-sample store (one row per sample, ``labels`` has 4
    path labels). Batching is the task's partitioning; ``columns`` prunes
    the scan (P2)."""
    df = spark.read.schema(SAMPLES).parquet(path)
    return df.select(*columns) if columns else df


CLAIMS_TRUTH = T.StructType([
    T.StructField("claim_id", T.LongType(), False),
    T.StructField("Claim", T.StringType(), True),
    T.StructField("cleaned_truthfulness", T.StringType(), True),
])


def read_claims_truth(spark: SparkSession, path: str) -> DataFrame:
    """Claims with their truthfulness label (CSV with header, quoted
    multi-line fields). ``_pos`` is the place in the files, by name, split and number, for
    "last row wins"."""
    return read_quoted(spark, path, CLAIMS_TRUTH, position="_pos")


def judged_claims(claims: DataFrame, judged: DataFrame, *, q_id: str = "claim_id") -> DataFrame:
    """Claims restricted to the judged ids (left semi join); for a
    repeated id the last row in file order wins (``max_by`` on ``_pos``, a
    partial aggregate); the claim text is stripped."""
    c = claims.join(judged.select(F.col(q_id)).distinct(), q_id, "left_semi")
    others = [x for x in c.columns if x not in (q_id, "_pos")]
    last = c.groupBy(q_id).agg(F.max_by(F.struct(*others), F.col("_pos")).alias("_r")).select(q_id, "_r.*")
    return last.withColumn("Claim", F.regexp_replace("Claim", r"^\s+|\s+$", ""))

"""The corpus pipeline: toxicity filter, near-duplicate removal, substring
de-duplication and packing, each over all that the stage before it kept.

A stage takes (spark, docs, sf_dir); its result is written and read again as the
next one's documents. The first three return the columns of documents.

Nulls and odd rows: a null text counts as empty and is kept; rows with a null
doc_id are judged by no filter and kept; rows that share a doc_id are one
document (they go if any of them is toxic or none is the one kept of its group of
near copies, and stay together otherwise); a text
from which nothing is removed stays as it is. Extra columns pass through to the
third stage. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.llm.near_dedup import near_duplicates
from verdict.llm.queries import held_out, packed_documents
from verdict.llm.store import stored
from verdict.llm.substring import remove_repeats
from verdict.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(~held_out())
    scored = score_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label")), threshold=0.3)
    return docs.join(scored.filter("predicted = 1").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_duplicates(docs, width=5, percent=75).filter("doc_id is not null")
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def strike_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    out = remove_repeats(docs, width=13).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", strike_repeats),
    ("packing", pack_sequences),
]

#: SQL can express neither the trees of the first stage nor the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

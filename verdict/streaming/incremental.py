"""Resumable enrichment. Only rows not yet in the output table are
captioned (J14 anti-join), enriched (P9b) and appended; an empty caption
still counts as done, because done-ness is the presence of the key in the
output, not a non-null caption.

``enrich_pending`` is the batch form; ``start_enrichment_stream`` runs the
same step per micro-batch over a growing folder of claim files with
``foreachBatch`` and a checkpoint in the cluster's shared checkpoint folder,
so a restarted job resumes where it stopped and a replayed batch appends
nothing twice.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import batch_score, enrich_online, pending
from ..session import checkpoint_dir

OUT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("caption", T.StringType()),
                           T.StructField("enriched", T.StringType())])


def _done(spark: SparkSession, out_path: str) -> DataFrame:
    try:
        return spark.read.schema(OUT_SCHEMA).parquet(out_path).select("id")
    except Exception as e:  # noqa: BLE001  (first run: no output yet)
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], "id long")
        raise


def enrich_pending(claims: DataFrame, out_path: str,
                   captioner: Callable[[pd.DataFrame], pd.DataFrame]) -> int:
    """One incremental run over ``claims(id, text, image)``: returns the
    number of rows appended. ``captioner`` maps a pandas batch with ``id,
    image`` to ``id, caption`` (the model hook, X2); the text passes it by. Of
    rows that share an id the least (text, image) counts; rows without an id
    are left out."""
    spark = claims.sparkSession
    todo = (pending(claims.filter("id is not null"), _done(spark, out_path), "id")
            .groupBy("id").agg(F.min(F.struct("text", "image")).alias("c")).select("id", "c.*"))

    def with_text(pdf: pd.DataFrame) -> pd.DataFrame:
        caps = captioner(pdf[["id", "image"]])[["id", "caption"]].drop_duplicates("id")
        return pdf[["id", "text"]].merge(caps, on="id", how="left")

    out = batch_score(todo, with_text, "id long, text string, caption string").select(
        "id", F.coalesce("caption", F.lit("")).alias("caption"),
        enrich_online(F.col("text"), F.coalesce("caption", F.lit(""))).alias("enriched"))
    out = out.persist()
    n = out.count()
    if n:
        out.write.mode("append").parquet(out_path)
    out.unpersist()
    return n


def start_enrichment_stream(spark: SparkSession, claims_dir: str, out_path: str,
                            captioner: Callable[[pd.DataFrame], pd.DataFrame],
                            claim_schema: T.StructType, name: str = "enrichment",
                            checkpoint: str | None = None):
    """Structured Streaming form of R1 over a folder of parquet claim
    files. Returns the started query. ``checkpoint``: folder of the stream's
    progress; by default ``{name}-stream`` beside the folders that Spark makes for
    each application, so that a restarted application finds it again."""
    ckpt = checkpoint or os.path.join(os.path.dirname(checkpoint_dir(spark).rstrip("/")), f"{name}-stream")
    stream = spark.readStream.schema(claim_schema).parquet(claims_dir)

    def step(batch: DataFrame, _epoch: int) -> None:
        enrich_pending(batch.select("id", "text", "image"), out_path, captioner)

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())


def last_processed_index(df: DataFrame, *, index: str = "idx", caption: str = "caption") -> DataFrame:
    """The position of the last row whose caption is set (a backward
    scan in the reference), as one aggregate; -1 when none. Superseded by
    the key-based anti-join above, which also fills earlier gaps."""
    return df.agg(F.coalesce(F.max(F.when(F.col(caption).isNotNull(), F.col(index))), F.lit(-1))
                  .alias("last_processed"))

"""Claim / evidence table preparation: image-path attach (P1, J15, S10),
complete-modality filter (P4), dense re-index (W7), caption enrichment
(P9a, P9b), prompt assembly (P10), answer parsing (P11, P12), key parsing and
path rewriting (P13-P18), resumable enrichment (J14, R1) and the batch
scorer hook (X2).

Everything except X2 is a column expression or a join; X2 runs a
user-supplied batch function with ``mapInPandas`` (Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import after_marker, has_marker, parse_answer_label
from ..session import cut_lineage, ship_package

# ---------------------------------------------------------------------------
# Prompt templates, with {question}, {claim}, {evidence} slots.
PROMPT_FACT_CHECK = (
    "You are an expert fact-checker. Your task is to verify if the given evidence supports or "
    "refutes the claim, or if there is not enough information to make a determination.\n\n"
    "    Claim: {claim}\n\n"
    "    Evidence: {evidence}\n\n"
    "    Based on the evidence, the claim is (respond with exactly one of: SUPPORT / NOT ENOUGH "
    "INFORMATION / REFUTE):")
PROMPT_MULTIMODAL = "<image>\nUSER:{question}\n claim:{claim}\n text evidence:{evidence}\nASSISTANT:"
PROMPT_IMAGE = "{question}\n claim:{claim}"
PROMPT_VERIFY_TEXT = "{question}\n ### claim:{claim}\n ### evidence:{evidence} ### Answer:"
PROMPT_RETRIEVE_TEXT = "{question}\n ### query:{claim}\n ### corpus:{evidence} ### Answer:"
PROMPT_TEXT_QUERY = "{question}\n text query:{claim}"
PROMPTS = {
    "fact_check": PROMPT_FACT_CHECK,
    "multimodal": PROMPT_MULTIMODAL,
    "image": PROMPT_IMAGE,
    "verify_text": PROMPT_VERIFY_TEXT,
    "retrieve_text": PROMPT_RETRIEVE_TEXT,
    "text_query": PROMPT_TEXT_QUERY,
}
# ---------------------------------------------------------------------------


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """Template with ``{slot}`` markers -> ``concat`` of literals and columns
    (a null slot makes the prompt null, like a failed format)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(slots[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


def enrich_batch(text: Column, caption: Column) -> Column:
    """Always ``text + '. ' + caption``; a null prints as ``nan``."""
    return F.concat(F.coalesce(text, F.lit("nan")), F.lit(". "), F.coalesce(caption, F.lit("nan")))


def enrich_online(text: Column, caption: Column) -> Column:
    """Append ``'. ' + caption`` only when the caption is non-empty."""
    return F.when(F.length(caption) > 0, F.concat(text, F.lit(". "), caption)).otherwise(text)


def attach_paths(claims: DataFrame, listing: DataFrame, *, id_col: str = "id",
                 path_col: str = "path") -> DataFrame:
    """``claim_image`` / ``evidence_image`` = the listed path named
    ``{id}_claim.jpg`` / ``{id}_evidence.jpg`` if it exists, else null. The
    listing is reduced to one row per id (max path per role) and left-joined
    once; no per-row filesystem probe. Columns of these names that the claims
    have already are kept as ``*_original``."""
    for role in ("claim_image", "evidence_image"):
        claims = claims.withColumnRenamed(role, f"{role}_original")
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    m = F.regexp_extract(name, r"^(\d+)_(claim|evidence)\.jpg$", 0)
    lst = listing.select(F.col(path_col).alias("_p"), name.alias("_n")).filter(m != "")
    lst = lst.select("_p", F.regexp_extract("_n", r"^(\d+)_", 1).cast("long").alias("_id"),
                     F.regexp_extract("_n", r"_(claim|evidence)\.jpg$", 1).alias("_role"))
    per_id = lst.groupBy("_id").agg(
        F.max(F.when(F.col("_role") == "claim", F.col("_p"))).alias("claim_image"),
        F.max(F.when(F.col("_role") == "evidence", F.col("_p"))).alias("evidence_image"))
    return claims.join(per_id, claims[id_col] == per_id["_id"], "left").drop("_id")


def complete_modality(df: DataFrame) -> DataFrame:
    """Keep a sample only when both images are usable."""
    return df.filter(F.col("claim_image").isNotNull() & F.col("evidence_image").isNotNull())


def dense_index(df: DataFrame, order_col: str, out: str = "idx") -> DataFrame:
    """0-based dense index in ``order_col`` order without a global
    single-partition window: range-partition and sort, count rows per
    partition (one small row per partition), prefix-sum the counts and add
    each row's offset inside its partition."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = (df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # the tagged rows are read twice (counts, then offsets): materialise them
    # once in the shared checkpoint folder, so a recomputation after a lost
    # executor cannot reorder equal keys between the two reads
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (s.join(F.broadcast(offs.select("_pid", "_off", "_m0")), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off"))


def parse_answers(answers: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """P11 + P12: returns (parsed, rejects). ``parsed`` has the free-text
    label (P11) and the answer after the marker, stripped and lower-cased
    (P12; rows without the marker keep their text). ``rejects`` are the rows
    without the marker (two outputs from one input)."""
    t = F.col(text_col)
    parsed = answers.select("*", parse_answer_label(t).alias("label"), has_marker(t).alias("has_marker"),
                            F.when(has_marker(t), after_marker(t)).otherwise(t).alias("answer"))
    rejects = answers.filter(~has_marker(t))
    return parsed, rejects


def decode_image_key(name: Column) -> dict[str, Column]:
    """First 17 characters split on ``-``: claim id, then a document id
    or the literal ``proof`` (= gold evidence)."""
    ids = F.split(F.substring(name, 1, 17), "-")
    doc = F.get(ids, 1)
    return {"claim_id": F.get(ids, 0).cast("long"), "is_gold": doc == "proof",
            "rel_doc_id": F.when(doc != "proof", doc.cast("long"))}


def passage_key(claim_id: Column, doc_id: Column, paragraph_id: Column) -> Column:
    """``claim-doc-paragraph``."""
    return F.concat_ws("-", claim_id, doc_id, paragraph_id)


def decode_split_key(key: Column) -> tuple[Column, Column]:
    """``train_123`` / ``test_123`` -> (split, id); anything else is
    (``''``, null) and is dropped by the caller."""
    return (F.regexp_extract(key, r"^(train|test)_(\d+)$", 1),
            F.regexp_extract(key, r"^(train|test)_(\d+)$", 2))


def normalise_separators(path: Column) -> Column:
    """``\\`` -> ``/``."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_evidence_image(name: Column) -> Column:
    """The last ``_`` token, before its first ``.``, is ``evidence``."""
    return F.substring_index(F.substring_index(name, "_", -1), ".", 1) == "evidence"


def canonical_path(name: Column, base: str = "images") -> Column:
    """``{split}_{rest}`` -> ``{base}/{split}/{rest}``; another prefix
    is an error (``raise_error``)."""
    after_first = F.regexp_extract(name, r"^[^_]*_(.*)$", 1)
    return (F.when(name.startswith("test"), F.concat(F.lit(f"{base}/test/"), after_first))
            .when(name.startswith("train"), F.concat(F.lit(f"{base}/train/"), after_first))
            .otherwise(F.raise_error(F.concat(F.lit("no split prefix in the file name: "), name))))


def pending(claims: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet processed (anti-join on the key)."""
    return claims.join(done.select(key), key, "left_anti")


def batch_score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a batch scorer (built once per task by the caller's closure)
    to Arrow batches of rows; ``fn`` maps a pandas batch to the output
    columns of ``schema``. A batch that fails is halved until the failing rows stand
    alone: such a row keeps the columns that input and output share, and is null in the rest."""
    ship_package(df.sparkSession)
    names = T.StructType.fromDDL(schema).names

    def scored(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield fn(pdf)
        except Exception:  # noqa: BLE001  (whatever a model raises concerns its rows only)
            if len(pdf) == 1:
                yield pd.DataFrame({c: pdf[c].to_list() if c in pdf else [None] for c in names})
            else:
                half = len(pdf) // 2
                yield from scored(pdf.iloc[:half].reset_index(drop=True))
                yield from scored(pdf.iloc[half:].reset_index(drop=True))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield from scored(pdf)
    return df.mapInPandas(run, schema)

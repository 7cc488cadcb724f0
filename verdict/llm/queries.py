"""Queries of the operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import CALLS, format_chat
from .collocations import collocations
from .hard_negatives import hard_negatives
from .near_dedup import near_duplicates
from .packing import pack, token_pieces
from .pivot_dedup import near_duplicate_vectors
from .quality_rules import judge_quality
from .store import new_path, stored
from .substring import remove_repeats
from .toxicity import score_toxicity
from .unigram import decode, encode
from .url_filter import judge_urls
from .va_file import top_k
from .warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, end_id=2, capacity=1024, special={"<|endoftext|>": 50256},
                          whole=public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(pieces, capacity=1024)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, width=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=75)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(_table(spark, sf_dir, "documents"), labels, threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


#: Fixed rules of the url filter: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))).alias("round_trip"))


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", is_query=F.col("id") % 100 == 0, k=10)


#: Tools of the conversations' calls: each assistant turn is a call
CHAT_TOOLS = {
    "answer": {"type": "object", "required": ["text", "lines"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1}, "lines": {"type": "integer", "minimum": 1}}},
    "summarise": {"type": "object", "required": ["text", "lines"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1, "maxLength": 1000}, "lines": {"type": "integer", "minimum": 1, "maximum": 12}}}}


def messages_with_calls(conversations: DataFrame) -> DataFrame:
    """The conversations with an assistant's turn as the call of a tool, which
    waits for the result of the call two turns before, and a user's turn as the
    result of the call one turn before."""
    call = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), F.col("turn").cast("string"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    said = F.struct(
        call.alias("id"), F.when(F.col("turn") % 4 == 3, "summarise").otherwise("answer").alias("name"),
        F.to_json(F.struct(F.col("text"), lines.alias("lines"))).alias("arguments"),
        F.when(F.col("turn") >= 3, F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"),
                                           (F.col("turn") - 2).cast("string"))).alias("after"))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("role") == "assistant", F.array(said)).otherwise(F.array().cast(CALLS)).cast(CALLS).alias("tool_calls"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), (F.col("turn") - 1).cast("string"))).alias("tool_call_id"))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(messages_with_calls(_table(spark, sf_dir, "conversations")), CHAT_TOOLS)


@query
def op9_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", cosine=0.98)


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, min_bytes=0)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, "vec_id", "embedding", "label", is_anchor=F.col("id") % 50 == 0)


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), support=30, longest=4, first=2000)


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"))

"""Nested claim documents in bounded segments.

A claim's evidence is put in order (document, place, kind) over the whole cluster
and cut into segments by the bytes of content before each item, so a segment
holds at most ``segment_bytes`` and one item. A claim with very much evidence is many
segments over many tasks; none of its rows, groups or windows holds all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TEXT, IMAGE = "text", "image"


def placed(items: DataFrame, segment_bytes: int) -> DataFrame:
    """Adds ``segment``: bytes of the claim's content before the item, in order,
    divided by ``segment_bytes``. Ranges of the order are sorted apart, and each gets the
    bytes that the claim has in earlier ranges from one row a claim and range."""
    order = ["claim_id", "doc_id", "place", "kind", "content"]
    sized = items.withColumn("_bytes", F.octet_length("content").cast("long"))
    ranges = cut_lineage(sized.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", "claim_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_claim").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranges.groupBy(F.col("claim_id").alias("_claim"), F.col("_range").alias("_of")).agg(F.sum("_bytes").alias("_all"))
              .withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all"))
    return (ranges.withColumn("_here", F.coalesce(F.sum("_bytes").over(within), F.lit(0)))
            .join(before, (F.col("claim_id") == F.col("_claim")) & (F.col("_range") == F.col("_of")))
            .withColumn("segment", F.floor((F.col("_here") + F.col("_before")) / segment_bytes).cast("long"))
            .drop("_bytes", "_range", "_claim", "_of", "_here", "_before"))


def _contents(kind: str) -> Column:
    """A document's contents of one kind, in order."""
    mine = F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "content")))
    return F.transform(F.sort_array(mine), lambda x: x["content"])


def claim_documents(items: DataFrame, segment_bytes: int = 8 << 20) -> DataFrame:
    """``claim_id, segment, documents``, where documents is an array of
    ``(doc_id, texts, images)``, from items ``(claim_id, doc_id, place, kind, content)``
    with kind ``text`` or ``image``. Null or empty contents do not count (P20), nor do items
    without a claim; items without a document come first. A document that crosses a border goes on in the next segment."""
    kept = items.filter("claim_id is not null and length(content) > 0")
    docs = placed(kept, segment_bytes).groupBy("claim_id", "segment", "doc_id").agg(
        _contents(TEXT).alias("texts"), _contents(IMAGE).alias("images"))
    return docs.groupBy("claim_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "texts", "images"))).alias("documents"))


def content_digest(documents: str = "documents") -> Column:
    """An MD5 of the documents' ids, texts and images, in order."""
    one = lambda d: F.concat_ws("\x1e", d["doc_id"].cast("string"), F.array_join(d["texts"], "\x1f"),
                                F.array_join(d["images"], "\x1f"))
    return F.md5(F.array_join(F.transform(documents, one), "\x1d").cast("binary"))

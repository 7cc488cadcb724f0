"""WARC archives: writing, and reading by boundary-chain verification.

Writing: one record a page. Of pages with equal payloads the one with the
largest page_id is a response with its payload, the others are revisit records
that refer to it and carry no payload. Spark's text writer writes the files, a
record a line, the line end being the end of a record.

Reading: files are cut at every occurrence of the magic, in parallel and in
any split; each piece is a candidate record with the offset of its successor.
A task links the candidates of its split, so that only where a chain enters and
leaves a split is left; pointer jumping from the start of each file over these
marks the splits' entries, and one pass marks the records on the chain.
Candidates off the chain are magics inside payloads; the pieces of a payload cut
by them are joined again.

Nulls: a null html is an empty payload, a null url leaves out the target, a null
page_id is kept as null (such a page revisits, if its payload has a response with
an id). Repeated rows are records of their own; rows that share the largest
page_id of a payload are all responses. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored
from .words import slices

# The format's own strings
MAGIC, END = "WARC/1.0\r\n", "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_M = len(MAGIC)


def base32_sha1(column):
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits."""
    hexed = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _id(column):
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))


def _header(name: str, value):
    """The header line, empty for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files. Payloads of less than
    ``min_bytes`` are never revisits."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    # a table of its own: where few payloads repeat, Spark sees its size and moves no payload for the join
    first = stored(p.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                   .filter("n > 1").select(F.xxhash64("digest").alias("hash"), F.col("digest").alias("same"), "first"), "repeated")
    # joined on the digest hashed anew, so that Spark can split a very common payload
    p = p.join(first, (F.xxhash64(p.digest) == first["hash"]) & (p.digest == first.same), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MAGIC), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _id(F.col("page_id"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Refers-To", F.when(revisit, _id(F.col("first")))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block, F.lit(END))
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def _parse(piece: bytes):
    """Length of the header and its fields by lower-case name, or None."""
    at = piece.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = {}
    for line in piece[:at].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon:
            fields[k.strip().lower()] = v.strip()
    size = fields.get(b"content-length", b"")
    return (at + 4, int(size), fields) if size.isdigit() and len(size) < 19 else None


def _page(urn: bytes | None):
    x = (urn or b"")[len(b"<urn:page:"):-1]
    return int(x) if x.lstrip(b"-").isdigit() else None


def _payload(block: bytes):
    """(size, digest) of what follows the HTTP head."""
    at = block.find(b"\r\n\r\n")
    body = block[at + 4:] if block.startswith(b"HTTP/") and at >= 0 else block
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


_CANDIDATE = ("file string, block long, rel long, size long, next long, leaves long, complete boolean, type string, "
              "page_id long, refers_to long, stated string, payload_bytes long, payload_digest string")


def _candidates(batches):
    """A row for each piece of a split: ``rel`` its place in the split, ``next``
    that of its successor, ``leaves`` where its chain leaves the split."""
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    schema_types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(),
                    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    split, rows, at = None, [], 0

    def flush():
        leaves: dict[int, int | None] = {}
        for r in reversed(rows):   # successors come later in the file
            leaves[r[2]] = None if r[4] is None else leaves.get(r[4], r[4])
        out = [(*r[:5], leaves[r[2]], *r[5:]) for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), schema_types)], names)

    for b in slices(batches, "value"):
        for file, block, piece in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            if split != (file, block):
                if rows:
                    yield flush()
                split, rows, at = (file, block), [], 0
            head = _parse(piece)
            if head is None:
                rows.append((file, block, at, len(piece), None, False, None, None, None, None, None, None))
            else:
                start, size, fields = head
                whole = len(piece) >= start + size
                n, digest = _payload(piece[start:start + size]) if whole else (None, None)
                stated = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
                rows.append((file, block, at, len(piece), at + start + size + 2 * len(END) + _M, whole,
                             fields.get(b"warc-type", b"").decode("ascii", "replace"),
                             _page(fields.get(b"warc-record-id")), _page(fields.get(b"warc-refers-to")),
                             stated, n, digest))
            at += len(piece) + _M
    if rows:
        yield flush()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, with its file and split, in file order."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("value")))


def _reachable_entries(cand: DataFrame) -> DataFrame:
    """(file, at) of the candidates at which the chain from the file's start
    enters a split: pointer jumping over (entry, where its chain leaves)."""
    starts = cand.select("file").distinct().withColumn("at", F.lit(_M).cast("long"))
    entries = cand.filter("leaves is not null").select("file", F.col("leaves").alias("at")).unionByName(starts).distinct()
    jump = stored(cand.select("file", "at", "leaves").join(entries, ["file", "at"]).filter("leaves is not null"), "jumps")
    reach, size = starts, -1
    while True:
        further = reach.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reach = stored(reach.unionByName(further).distinct(), "reached")
        now = reach.count()
        if now == size:
            return reach
        size = now
        second = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
        jump = stored(jump.join(second, ["file", "leaves"], "left")
                      .select("file", "at", F.coalesce("then", "leaves").alias("leaves")), "jumps")


def _on_chain(batches):
    """Rows in file order: ``owner`` is the place of the record on the chain
    that a piece belongs to, null before the first of the split."""
    split, expected, owner = None, None, None
    for b in batches:
        out = []
        for file, block, at, nxt, entry in zip(*(b.column(c).to_pylist() for c in ("file", "block", "at", "next_at", "entry"))):
            if split != (file, block):
                split, expected, owner = (file, block), None, None
            if entry or at == expected:
                owner, expected = at, nxt
            out.append(owner)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "owner"])


def _joined(batches):
    """Payload size and digest of records whose pieces were cut by magics."""
    for b in batches:
        done = []
        for size, parts in zip(b.column("size").to_pylist(), b.column("parts").to_pylist()):
            text = MAGIC.encode().join(p["value"] for p in parts)
            start, length, _ = _parse(text)
            done.append(_payload(text[start:start + length]))
        yield pa.RecordBatch.from_arrays(
            [b.column("file"), b.column("owner"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])],
            ["file", "owner", "joined_bytes", "joined_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified)
    of every record of the archives. A revisit has the size of the record that
    it refers to; ``verified``: the payload has the digest that the header states."""
    cand = stored(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates")
    ends = cand.groupBy("file", "block").agg(F.sum(F.col("size") + _M).alias("bytes"))
    base = ends.select("file", "block", (F.sum("bytes").over(
        Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base"))
    placed = cand.join(base, ["file", "block"])
    placed = placed.withColumn("at", F.col("base") + F.col("rel")).withColumn("next_at", F.col("base") + F.col("next")) \
        .withColumn("leaves", F.col("base") + F.col("leaves"))
    entries = _reachable_entries(placed).withColumn("entry", F.lit(True))
    names = ["file", "block", "rel", "at", "next_at", "complete", "type", "page_id", "refers_to", "stated", "payload_bytes", "payload_digest"]
    kinds = {"file": "string", "complete": "boolean", "entry": "boolean", "type": "string", "stated": "string", "payload_digest": "string"}
    marked = (placed.join(entries, ["file", "at"], "left").select(*names, "entry")
              .repartition("file", "block").sortWithinPartitions("file", "block", "at")
              .mapInArrow(_on_chain, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*names, "entry", "owner"])))
    marked = stored(marked, "chain")
    records = marked.filter("owner = at and type is not null")
    if records.filter("not complete").isEmpty():
        records = records.withColumn("joined_bytes", F.lit(None).cast("long")).withColumn("joined_digest", F.lit(None).cast("string"))
    else:
        # a record may go on in later splits: there its pieces come before the first entry
        owned = marked.withColumn("owner", F.last("owner", ignorenulls=True).over(
            Window.partitionBy("file").orderBy("at")))
        cut = (owned.join(records.filter("not complete").select("file", F.col("at").alias("owner"), F.col("next_at").alias("stop")),
                          ["file", "owner"]).filter(F.col("at") < F.col("stop")).select("file", "block", "rel", "at", "owner"))
        again = _pieces(spark, path).mapInArrow(_with_place, "file string, block long, rel long, value binary")
        whole = (again.join(cut, ["file", "block", "rel"]).groupBy("file", "owner")
                 .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"), F.count("*").alias("size"))
                 .mapInArrow(_joined, "file string, owner long, joined_bytes long, joined_digest string"))
        records = records.join(whole, ["file", "owner"], "left")
    records = (records.withColumn("payload_bytes", F.coalesce("joined_bytes", "payload_bytes"))
               .withColumn("payload_digest", F.coalesce("joined_digest", "payload_digest"))
               .withColumn("verified", F.col("payload_digest") == F.col("stated")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    full = records.filter("type <> 'revisit'").withColumn("record_type", F.col("type")).select(*out)
    known = (full.filter("page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
             .select(F.xxhash64("page_id", "payload_digest").alias("hash"), F.col("page_id").alias("id"), "payload_digest", "payload_bytes"))
    r = records.filter("type = 'revisit'").select("page_id", "refers_to", "stated")
    revisits = r.join(known, (F.xxhash64(r.refers_to, r.stated) == known["hash"]) & (r.refers_to == known.id)
                      & (r.stated == known.payload_digest), "left").select(
        "page_id", "payload_bytes", F.col("stated").alias("payload_digest"), F.lit("revisit").alias("record_type"),
        "refers_to", F.col("hash").isNotNull().alias("verified"))
    return full.unionByName(revisits)


def _with_place(batches):
    """The pieces with their place in the split."""
    split, at = None, 0
    for b in slices(batches, "value"):
        out = []
        for file, block, piece in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            if split != (file, block):
                split, at = (file, block), 0
            out.append(at)
            at += len(piece) + _M
        yield pa.RecordBatch.from_arrays(
            [b.column("file"), b.column("block"), pa.array(out, pa.int64()), b.column("value")], ["file", "block", "rel", "value"])

"""Substring de-duplication over FM-index shards.

A window is ``width`` consecutive words of one document. A word goes if a
window over it also starts in a document with a smaller doc_id.

* Each window has an anchor: its ``anchor``-word run of least hash. Equal
  windows have equal anchors, so only runs of windows (segments) under the same
  anchor are compared. One shuffle by anchor tells what is alone (gone), what
  repeats an earlier equal segment (removed as it stands), and the rest.
* The words of the rest go to shards by anchor. Each shard builds FM-indexes of
  bounded size and streams its segments through backward search; matching
  statistics of ``width`` words report the interval of equal windows, whose least
  doc_id decides.
* Anchors with more than ``hot`` segments go on by whole-window hash, one window
  a segment, so an index never outgrows ``hot`` segments plus one block.

Nulls: a null text has no words; a row with null doc_id neither removes nor
loses words. Repeated rows are treated each on its own; rows with one doc_id
never remove each other's words. Extra columns are kept, but a column named as
one of the new ones is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .words import Words, constants, mix64, runs, slices

_U = np.uint64
_SEED_ANCHOR, _SEED_WINDOW, _SEED_SEG = 101, 102, 103


def _segments(h: np.ndarray, doc: np.ndarray, width: int, anchor: int):
    """Runs of windows with the same anchor place: first window, number of
    windows, anchor hash."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    g = runs(h, anchor, _SEED_ANCHOR)
    least, place = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width - anchor + 1):
        v = g[j:j + n]
        less = v < least
        least[less] = v[less]
        place[less] = j
    place += np.arange(n)
    whole = doc[:n] == doc[width - 1:]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.r_[new[1:] | ~whole[1:], True] & whole) + 1
    return first, stop - first, least[first]


def _segment_hash(h: np.ndarray, first: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(constants(_SEED_SEG, longest)):
            there = size > j
            out[there] += h[first[there] + j] * c
    return mix64(out)


def _anchors(width: int, anchor: int):
    """Rows (key, seg, doc_id, mark, at): at is the first window of a segment
    in its document * 64 + the number of windows; seg is null if a smaller
    document of the same slice has an equal segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            h = w.hashes()
            first, n, least = _segments(h, w.doc, width, anchor)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            mark = b.column("mark").to_numpy(zero_copy_only=False)[w.doc[first]]
            seg = _segment_hash(h, first, n + width - 1, 2 * width - anchor)
            doc = ids[w.doc[first]].astype(np.int64)
            at = (first - w.first[w.doc[first]]) * 64 + n
            order = np.lexsort((doc, seg))
            s, d = seg[order], doc[order]
            begin = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
            least_doc = d[np.flatnonzero(begin)][np.cumsum(begin) - 1] if len(s) else d
            known = np.zeros(len(s), bool)
            known[order] = d > least_doc
            key = least.copy()
            key[known] = mix64(at[known].astype(np.uint64) + mix64(doc[known].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64), mask=known),
                 pa.array(doc), pa.array(mark), pa.array(at)],
                ["key", "seg", "doc_id", "mark", "at"])
    return run


def _extract(width: int):
    """From documents with their ``found`` list: a row of the words of every
    segment to search, and one row a document of what is already settled."""
    def run(batches):
        for b in slices(x.filter(pc.is_valid(x.column("found"))) for x in batches):
            w = Words(b.column("text"))
            h = w.hashes()
            lists = b.column("found")
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            at = flat.field("at").to_numpy(zero_copy_only=False)
            kind = flat.field("kind").to_numpy(zero_copy_only=False)
            key = flat.field("key").to_numpy(zero_copy_only=False)
            first, n = at >> 6, at & 63
            done = kind == 0
            # a hot anchor's windows, each a segment of its own
            hot = kind == 2
            one = np.repeat(np.flatnonzero(hot), n[hot])
            step = np.arange(len(one)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            plain = np.flatnonzero(kind == 1)
            src = np.r_[plain, one]
            start = np.r_[first[plain], first[one] + step]
            count = np.r_[n[plain], np.ones(len(one), np.int64)]
            begin = w.first[row[src]] + start
            size = count + width - 1
            keys = key[src].copy()
            if len(one):
                whole = runs(h, width, _SEED_WINDOW)
                keys[len(plain):] = whole[begin[len(plain):]].view(np.int64)
            # the words of the segments, one after the other
            offset = np.r_[0, np.cumsum(size)]
            words = h[np.arange(offset[-1]) - np.repeat(offset[:-1] - begin, size)]
            # settled spans: one row a document
            rows, cut = np.unique(row[done], return_index=True)
            spans = np.stack([first[done], first[done] + n[done] + width - 1], 1).astype(np.int64)
            end = np.r_[cut[1:], len(spans)]
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            mark = b.column("mark").to_numpy(zero_copy_only=False)
            blob = [None] * len(src) + [spans[i:j].tobytes() for i, j in zip(cut, end)]
            seq = [words[i:j].tobytes() for i, j in zip(offset[:-1], offset[1:])] + [None] * len(rows)
            of = np.r_[row[src], rows].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[keys, mix64(rows.astype(np.uint64) + ids[rows].astype(np.uint64)).view(np.int64)]),
                 pa.array(ids[of]), pa.array(mark[of]),
                 pa.array(np.r_[start, np.zeros(len(rows), np.int64)]),
                 pa.array(seq, pa.binary()), pa.array(blob, pa.binary())],
                ["key", "doc_id", "mark", "start", "words", "spans"])
    return run


def _search_block(words: list[bytes], doc: np.ndarray, width: int):
    """One FM-index over the segments of a block, all streamed through it:
    per window found in a smaller document its segment and place in it."""
    size = np.array([len(x) // 8 for x in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint64)
    codes, ids = np.unique(flat, return_inverse=True)
    text = np.zeros(len(flat) + len(size), np.int64)
    begin = np.r_[0, np.cumsum(size + 1)]
    seg = np.repeat(np.arange(len(size)), size)
    text[np.arange(len(flat)) + seg] = ids + 1
    index = FMIndex(text, len(codes) + 1, width)
    n = size - width + 1
    of = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    length, lo, hi = index.matching_statistics(text, begin[of] + place + width, width)
    hit = np.flatnonzero(length >= width)
    if not len(hit):
        return hit, hit
    owner = np.repeat(np.arange(len(size)), size + 1)
    in_order = np.r_[doc[owner[index.order]], np.iinfo(np.int64).max]
    classes, inverse = np.unique(lo[hit], return_inverse=True)
    highs = np.zeros(len(classes), np.int64)
    highs[inverse] = hi[hit]
    least = np.minimum.reduceat(in_order, np.stack([classes, highs], 1).ravel())[::2]
    hit = hit[least[inverse] < doc[of[hit]]]
    return of[hit], place[hit]


def _search(width: int, block_words: int):
    """Rows sorted by key: blocks of whole keys, searched; (doc_id, mark, spans)."""
    def flush(keys, docs, marks, starts, words):
        seg, place = _search_block(words, docs, width)
        cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else seg
        begin = starts[seg] + place
        spans = np.stack([begin, begin + width], 1).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs[seg[cut]]), pa.array(marks[seg[cut]]),
             pa.array([spans[i:j].tobytes() for i, j in zip(cut, np.r_[cut[1:], len(seg)])], pa.binary())],
            ["doc_id", "mark", "spans"])

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None      # last: key and words of the row before
        for b in batches:
            settled = b.filter(pc.is_valid(b.column("spans")))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [settled.column(c) for c in ("doc_id", "mark", "spans")], ["doc_id", "mark", "spans"])
            b = b.filter(pc.is_valid(b.column("words")))
            cols = [b.column(c).to_pylist() for c in ("key", "doc_id", "mark", "start", "words")]
            again: list[tuple] = []
            for r in zip(*cols):
                if last is not None and r[0] == last[0] and r[4] == last[2]:
                    if r[1] > last[1]:   # an equal segment of a later document
                        again.append((r[1], r[2], np.array([r[3], r[3] + len(r[4]) // 8], np.int64).tobytes()))
                        continue
                if size >= block_words and r[0] != held[-1][0]:
                    k, d, m, s, x = zip(*held)
                    yield flush(k, np.array(d), np.array(m), np.array(s), x)
                    held, size = [], 0
                if last is None or r[0] != last[0] or r[4] != last[2]:
                    last = (r[0], r[1], r[4])
                held.append(r)
                size += len(r[4]) // 8
            if again:
                d, m, s = zip(*again)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.binary())],
                    ["doc_id", "mark", "spans"])
        if held:
            k, d, m, s, x = zip(*held)
            yield flush(k, np.array(d), np.array(m), np.array(s), x)
    return run


def _strike(names: list[str]):
    """Adds kept_text, n_words and n_removed."""
    def run(batches):
        for b in slices(batches):
            w = Words(b.column("text"))
            total = np.diff(w.first)
            out = np.zeros(len(w.start) + 1, np.int64)
            spans = b.column("spans").to_pylist()
            for i, s in enumerate(spans):
                if s:
                    p = np.frombuffer(b"".join(s), np.int64).reshape(-1, 2) + w.first[i]
                    np.add.at(out, p[:, 0], 1)
                    np.add.at(out, p[:, 1], -1)
            kept = np.cumsum(out)[:-1] == 0
            n_kept = np.r_[0, np.cumsum(kept)][w.first]
            n_kept = np.diff(n_kept)
            # the bytes of kept words and one space between two of them
            edge = np.zeros(len(w.raw) + 1, np.int8)
            edge[w.start[kept]] += 1
            edge[w.end[kept]] -= 1
            take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            order = np.flatnonzero(kept)
            inner = order[:-1][w.doc[order[:-1]] == w.doc[order[1:]]] if len(order) else order
            raw = w.raw.copy()
            raw[w.end[inner]] = 0x20
            take[w.end[inner]] = True
            data = raw[take]
            offsets = np.r_[0, np.cumsum(take)][w.offsets].astype(np.int64)
            text = pa.Array.from_buffers(
                pa.large_utf8(), b.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [text.cast(pa.utf8()), pa.array(total.astype(np.int64)),
                                               pa.array((total - n_kept).astype(np.int64))],
                [*names, "kept_text", "n_words", "n_removed"])
    return run


def remove_repeats(docs: DataFrame, width: int = 13, anchor: int = 4, hot: int = 20_000,
                   block_words: int = 400_000) -> DataFrame:
    """``docs`` (doc_id, text, more) with ``kept_text`` (kept words joined by
    one space), ``n_words`` and ``n_removed``.

    ``hot``: segments of one anchor from which its windows go on singly;
    ``block_words``: words in one FM-index (a key's segments stay together)."""
    new = ("kept_text", "n_words", "n_removed")
    names = [c for c in docs.columns if c not in new]
    more = [c for c in names if c not in ("doc_id", "text")]
    # rows of one doc_id with other text keep apart by a mark of the text
    marked = docs.select("doc_id", "text", (F.xxhash64("text") % F.lit(1 << 20)).alias("mark"),
                         *([F.struct(*(F.col(f"`{c}`") for c in more)).alias("more")] if more else []))
    text = marked.select("doc_id", "text", "mark")
    found = (text.filter("doc_id is not null and text is not null")
             .mapInArrow(_anchors(width, anchor), "key long, seg long, doc_id long, mark long, at long"))
    by_seg, by_key = Window.partitionBy("key", "seg"), Window.partitionBy("key")
    judged = (found.repartition(F.col("key"))
              .withColumn("least", F.when(F.col("seg").isNotNull(), F.min("doc_id").over(by_seg)))
              .withColumn("n", F.sum(F.when(F.col("doc_id") == F.col("least"), 1)).over(by_key))
              .withColumn("lone", F.min("least").over(by_key) == F.max("doc_id").over(by_key))
              .withColumn("same", F.min("seg").over(by_key) == F.max("seg").over(by_key))
              .withColumn("kind", F.when(F.col("seg").isNull() | (F.col("doc_id") > F.col("least")), 0)
                          .when(F.col("lone") | F.col("same"), None)
                          .when(F.col("n") > hot, 2).otherwise(1))
              .filter("kind is not null"))
    lists = (judged.groupBy("doc_id", "mark")
             .agg(F.collect_list(F.struct("at", "key", "kind")).alias("found")))
    # both joins to the texts are left joins of all the same columns, so one
    # shuffle of the texts serves both
    parts = (marked.join(lists, ["doc_id", "mark"], "left").mapInArrow(
        _extract(width), "key long, doc_id long, mark long, start long, words binary, spans binary"))
    hits = (parts.repartition(F.col("key")).sortWithinPartitions("key", "words", "doc_id")
            .mapInArrow(_search(width, block_words), "doc_id long, mark long, spans binary"))
    spans = hits.groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("spans"))
    kept = [c for c in marked.columns if c != "mark"]
    schema = T.StructType([marked.schema[c] for c in kept]).add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    out = (marked.join(spans, ["doc_id", "mark"], "left").select(*kept, "spans")
           .mapInArrow(_strike(kept), schema))
    return out.select(*(F.col(f"more.`{c}`").alias(c) if c in more else c for c in names), *new)

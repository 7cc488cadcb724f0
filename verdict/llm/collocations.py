"""Phrase collocations per language by Toivonen's sampling method.

1. A share of the documents is mined level by level with a lowered support: it
   proposes phrases.
2. A full pass counts, exactly, the proposed phrases and their negative border: a
   phrase of n words is counted if n is 1 or both of its phrases of n - 1 words are
   proposed. The border is so given by the phrases that occur, never listed.
3. A counted phrase that reaches the support but was not proposed is a border
   failure. Failures join the proposals, and an expansion pass counts what they let
   in: each phrase that was not counted yet and of whose parts none is known to be
   rare. No phrase is frequent beyond these, as no part of a phrase occurs less often
   than the phrase, so this pass closes. (The sample, which starts from no
   proposals, takes an expansion pass a level until one has no failure.)
4. Frequent phrases of two and more words are candidates; each is scored by its
   weakest cut, dropped if a longer candidate mostly holds it, and ranked.

Proposals are tested in a Bloom filter of about 16 bits a phrase and at most
``max_filter_bits`` bits, the only thing that is broadcast. A false positive counts a phrase that need not be counted, and
is not a failure; all passes agree on it, so results do not depend on
the filter's size nor on the sample. Counts are by the phrases' texts, summed per batch before the
shuffle.

Words are ``[^\\x20\\x09]+`` of the pieces between ``[.,;:!?\\x0A-\\x0D]``, with A-Z lower-cased.

Nulls: a null text is empty, a null language is ``und``; ids are not read. Repeated
rows count each. Ties of the cut go to the shorter first part, ties of the rank to the
greater count, then the smaller phrase in byte order. A text is never cut: from 1 MB on it is a
batch of its own, whose phrases are counted in runs of words. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .words import Words, constants, mix64, slices

_U = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[ord(c) for c in " \t.,;:!?\n\x0b\x0c\r"]] = False
_IS_CUT = np.zeros(256, bool)
_IS_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_STEP = constants(41, 8)
_BLOCK = 4096           # 64-bit words of a block of the filter
SLICE_BYTES = 1 << 20   # text bytes counted at a time
RUN = 1 << 16           # words whose phrases are counted at a time


def _lang_hashes(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)


def _keys(h: np.ndarray, lang: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, and of their language."""
    with np.errstate(over="ignore"):
        total = lang[at] * _STEP[7] + _U(n)
        for j in range(n):
            total += h[at + j] * _STEP[j]
    return mix64(total)


def _places(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, its four bits) of each key."""
    bits = np.zeros(len(key), np.uint64)
    for i in range(4):
        bits |= _U(1) << ((key >> _U(6 * i)) & _U(63))
    return ((key >> _U(24)) % _U(size)).astype(np.int64), bits


class Filter:
    """A Bloom filter of phrases, in 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, key: np.ndarray) -> np.ndarray:
        at, bits = _places(key, len(self.words))
        return self.words[at] & bits == bits


class Phrases:
    """Phrases of a batch: words joined by one space in ``text``, from
    ``start[i]`` to ``end[i + n - 1]``; ``piece`` tells where phrases end."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        w = Words(texts, _IS_WORD)
        self.h = w.hashes(lower=True)
        n = len(w.start)
        cut = np.cumsum(_IS_CUT[w.raw], dtype=np.int32 if len(w.raw) < 1 << 31 else np.int64)
        new = np.ones(n, bool)
        if n:
            at = cut[w.start]
            new[1:] = (at[1:] != at[:-1]) | (w.doc[1:] != w.doc[:-1])
        self.piece = np.cumsum(new)
        self.lang = langs[w.doc]
        length = w.end - w.start
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        raw = _LOWER[w.raw]
        self.text = np.full(int(self.end[-1]) + 1 if n else 0, 0x20, np.uint8)
        inside = np.ones(len(self.text), bool)
        inside[self.end] = False
        self.text[inside] = raw[_IS_WORD[w.raw]]

    def strings(self, at: np.ndarray, n: int) -> pa.Array:
        start, length = self.start[at], self.end[at + n - 1] - self.start[at]
        ends = np.cumsum(length)
        low = start[0]
        small = int(ends[-1]) + int(start[-1] - low) < 1 << 31
        kind = np.int32 if small else np.int64
        data = self.text[low:][np.arange(ends[-1], dtype=kind) + np.repeat((start - low - (ends - length)).astype(kind), length)]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _let_in(h: np.ndarray, lang: np.ndarray, piece: np.ndarray, longest: int, new: Filter, old: Filter | None, closing: bool):
    """(n, places) of the phrases of n words that ``new`` lets in and ``old`` did not.
    ``closing`` also lets in what stands on phrases that were not counted before."""
    every = np.arange(len(h))
    key = _keys(h, lang, every, 1)
    part = new.has(key)
    old_part = part & old.has(key) if old is not None else np.zeros(len(h), bool)
    if old is None:
        yield 1, every
    for n in range(2, longest + 1):
        if len(h) < n:
            return
        at = np.flatnonzero(part[:-1] & part[1:] & (piece[:len(h) - n + 1] == piece[n - 1:]))
        counted = old_part[at] & old_part[at + 1]
        yield n, at[~counted]
        if n == longest:
            return
        key = _keys(h, lang, at, n)
        known = new.has(key)
        part, old_part = np.zeros(len(h) - n + 1, bool), np.zeros(len(h) - n + 1, bool)
        part[at] = known | ~counted if closing and old is not None else known
        if old is not None:
            old_part[at] = counted & old.has(key)


def _counts(longest: int, now, before, closing: bool = False):
    """(key, n) of the phrases of a pass; the first pass, with no ``before``, also
    gives the number of all words (as the empty phrase)."""
    def run(batches):
        new = Filter(np.frombuffer(now.value, np.uint64))
        old = Filter(np.frombuffer(before.value, np.uint64)) if before is not None else None
        for b in slices(batches, max_bytes=SLICE_BYTES):
            langs = b.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            p = Phrases(b.column("text"), langs.indices.to_numpy(zero_copy_only=False))
            seeds = _lang_hashes(names)
            if old is None:
                total = np.bincount(p.lang, minlength=len(names))
                yield _rows(names, np.arange(len(names)), pa.array([""] * len(names), pa.string()), total)
            for i in range(0, len(p.h), RUN):
                # the words of the run, and what phrases that begin in it need of the next
                reach = slice(i, i + RUN + longest - 1)
                for n, at in _let_in(p.h[reach], seeds[p.lang[reach]], p.piece[reach], longest, new, old, closing):
                    at = i + at[at < RUN]
                    if len(at):
                        t = pa.table({"lang": pa.array(p.lang[at].astype(np.int32)), "phrase": p.strings(at, n)}) \
                            .group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                        yield _rows(names, t.column("lang").to_numpy(), t.column("phrase").cast(pa.string()).combine_chunks(),
                                    t.column("count_all").to_numpy())
    return run


def _rows(names: list[str], code: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """(key, n): a key is the phrase, a tab (which no phrase holds) and the language."""
    lang = pa.array(names, pa.string()).take(pa.array(code))
    return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrase, lang, "\t"), pa.array(n.astype(np.int64))], ["key", "n"])


_COUNTS = "lang string, words int, phrase string, n long"


def _summed(rows: DataFrame, support: int) -> DataFrame:
    """Sums of (key, n) from ``support`` on, and of the rows without a phrase."""
    phrase = F.substring_index("key", "\t", 1)
    return (rows.groupBy("key").agg(F.sum("n").alias("n")).filter(f"n >= {support} or key like '\t%'")
            .select(F.expr("substring(key, instr(key, '\t') + 1)").alias("lang"),
                    F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "n"))


def _phrase_keys(b: pa.RecordBatch) -> np.ndarray:
    """The hash of each phrase of a counts table."""
    out = np.zeros(b.num_rows, np.uint64)
    w = Words(b.column("phrase"), _IS_WORD)
    h = w.hashes()
    langs = b.column("lang").dictionary_encode()
    lang = _lang_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
    size = b.column("words").to_numpy()
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        with np.errstate(over="ignore"):
            total = lang[rows] * _STEP[7] + _U(n)
            for j in range(n):
                total += h[w.first[rows] + j] * _STEP[j]
        out[rows] = mix64(total)
    return out


def _failures(now):
    """The rows that ``now`` does not hold."""
    def run(batches):
        seen = Filter(np.frombuffer(now.value, np.uint64))
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(~seen.has(_phrase_keys(b))))
    return run


def _placed(size: int):
    def run(batches):
        for b in batches:
            at, bits = _places(_phrase_keys(b), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // _BLOCK).astype(np.int32)), pa.array((at % _BLOCK).astype(np.int32)), pa.array(bits.view(np.int64))],
                ["block", "at", "bits"])
    return run


def _block(key, t):
    words = np.zeros(_BLOCK, np.uint64)
    words[t.column("at").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})


def _filter(phrases: DataFrame, size: int) -> bytes:
    """The filter of a counts table, in ``size`` 64-bit words. The driver gets its
    blocks, which hold no more than that in all."""
    placed = phrases.mapInArrow(_placed(size), "block int, at int, bits long")
    blocks = placed.groupBy("block", "at").agg(F.bit_or("bits").alias("bits")).groupBy("block") \
        .applyInArrow(_block, "block int, words binary")
    out = bytearray(8 * size)
    for block, words in blocks.take(size // _BLOCK):
        out[8 * _BLOCK * block:8 * _BLOCK * (block + 1)] = words
    return bytes(out)


def _frequent(texts: DataFrame, support: int, longest: int, proposed: DataFrame | None, max_filter_bits: int,
              scratch: Scratch) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of up to ``longest`` words that occur
    ``support`` times, and the number of all words (words 0). Without
    proposals each pass counts the next level; with proposals the pass after the
    first one closes."""
    sc = texts.sparkSession.sparkContext

    def sized(keys: int) -> int:
        """Words of a filter with 16 bits a key, within the bound."""
        size = _BLOCK
        while 64 * size < 16 * keys and 128 * size <= max_filter_bits:
            size *= 2
        return size

    size = _BLOCK if proposed is None else sized(proposed.count())
    now = sc.broadcast(bytes(8 * size) if proposed is None else _filter(proposed, size))
    before, found, closing = None, None, proposed is not None
    while True:
        part = scratch.stored(
            _summed(texts.mapInArrow(_counts(longest, now, before, closing), "key string, n long"), support), "counts")
        found = part if found is None else found.unionByName(part)
        n_failed = 0
        if before is None or not closing:
            # a phrase of full length lets no other in
            failed = scratch.stored(part.filter(f"words between 1 and {longest - 1}")
                                    .mapInArrow(_failures(now), _COUNTS), "failures")
            n_failed = failed.count()
        if before is not None:
            before.destroy()
        if not n_failed:
            now.destroy()
            return found
        old = np.frombuffer(now.value, np.uint64)
        if proposed is None and before is None:     # the empty filter is part of any: these are the words, of some levels
            size = sized(longest * n_failed)
            old = np.zeros(size, np.uint64)
        before, now = now, sc.broadcast((old | np.frombuffer(_filter(failed, size), np.uint64)).tobytes())


def _cuts(words: str, phrase: str):
    """Struct array of the cuts of a phrase into a first part of k words and the rest."""
    parts = F.split(phrase, " ")
    return F.transform(F.sequence(F.lit(1), F.col(words) - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(parts, 1, k), " ").alias("left"),
        F.array_join(F.slice(parts, k + 1, F.col(words) - k), " ").alias("right")))


def _inner(words: str, phrase: str):
    """The phrases of two and more words within a longer one."""
    parts = F.split(phrase, " ")
    sizes = F.sequence(F.lit(2), F.col(words) - 1)
    return F.array_distinct(F.flatten(F.transform(sizes, lambda m: F.transform(
        F.sequence(F.lit(1), F.col(words) - m + 1), lambda i: F.array_join(F.slice(parts, i, m), " ")))))


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", support: int = 30, longest: int = 4,
                 scale: int = 2_000_000, held: int = 80, first: int = 2000, share: float = 0.125, lowered: float = 0.8,
                 max_filter_bits: int = 1 << 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to
    ``longest`` words that occur ``support`` times.

    ``share``: of the documents, sampled; ``lowered``: support of the sample, as a share of
    what the sample would hold; ``held``: percent of a phrase's occurrences in a longer
    candidate that drop it."""
    scratch = Scratch()
    texts = docs.select(F.coalesce(lang_column, F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    least = max(2, round(support * share * lowered))
    proposed = scratch.stored(
        _frequent(texts.sample(share, seed=7), least, longest, None, max_filter_bits, scratch)
        .filter("words > 0"), "proposed")
    found = _frequent(texts, support, longest, proposed, max_filter_bits, scratch)
    known = scratch.stored(found.filter("words > 0"), "frequent")
    totals = found.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = known.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    # a part of a frequent phrase is frequent, so both joins keep every cut
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = (candidates.select("lang", "words", "phrase", "a", F.inline(_cuts("words", "phrase")))
            .join(left, ["lang", "left"]).join(right, ["lang", "right"]))
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (cuts.withColumn("score", score).groupBy("lang", "words", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    holders = (candidates.filter("words >= 3").select("lang", "a", F.explode(_inner("words", "phrase")).alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    free = (scored.join(holders, ["lang", "phrase"], "left")
            .filter(f"longer is null or 100 * cast(longer as decimal(20,0)) < {held} * cast(a as decimal(20,0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return scratch.result(ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score")), "ranked")

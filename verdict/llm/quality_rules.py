"""Quality rules: repetition and length rules, then the divergence of a
document's character classes and common words from its language's.

1. A pass over all texts counts, per language, the code points of each character
   class and the words of the documents that the base rules keep. Each batch is
   counted before its rows are shuffled.
2. A language's reference is the histogram of its character classes and of its
   ``common`` most frequent words (ties: smaller word first), all other words in
   one more bin.
3. A second pass compares every document with its language's reference by
   Jensen-Shannon distance (square root of the divergence, base 2, in [0, 1],
   rounded to 6 places). Too great a distance rejects. A histogram only judges from
   ``min_chars`` code points or ``min_words`` words on, and only if the
   reference holds ``min_reference`` words: shorter texts differ by chance.

Base rules: fewer than 10 words, or over a fifth of the words in 5-word windows
that the text holds twice or more.

Nulls: a null text has no words and fails the base rules; a null language is
``und``; a null id stays null. Repeated rows are judged each by itself, and count
each in the references. An empty table gives no rows. Only the named columns are
read, so other columns do not matter. A text is a batch of its own from 1 MB on,
and held whole by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .words import Words, mix64, runs, slices

#: Character classes by byte (fixed values): the lead byte of a longer UTF-8
#: sequence tells U+00C0..U+023F (Latin letters) from all others
CLASSES = ("vowels", "consonants", "capitals", "digits", "blanks", "punctuation", "symbols", "latin", "other")
_SKIP = len(CLASSES)
_CLASS = np.full(256, 6, np.int64)
_CLASS[[ord(c) for c in "aeiou"]] = 0
_CLASS[[ord(c) for c in "bcdfghjklmnpqrstvwxyz"]] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[0x80:0xC0] = _SKIP
_CLASS[0xC0:] = 8
_CLASS[0xC3:0xC9] = 7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(marked)][offsets])


def _repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(_BLANK):
            n += line in seen
            seen.add(line)
    return n


class Profile:
    """What the base rules look at, for the rows of one batch."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column)
        rows = len(w.offsets) - 1
        at = np.repeat(np.arange(rows), np.diff(w.offsets))
        self.classes = np.bincount(at * (_SKIP + 1) + _CLASS[w.raw], minlength=rows * (_SKIP + 1)) \
            .reshape(rows, _SKIP + 1)[:, :_SKIP]
        self.n_words = np.diff(w.first)
        self.word_chars = self.classes.sum(1) - self.classes[:, 4]
        self.n_symbols = _per_row(_SYMBOL[w.raw], w.offsets)
        raw = w.raw.tobytes()
        self.n_dup_lines = np.array([_repeated_lines(raw[a:z]) for a, z in zip(w.offsets[:-1], w.offsets[1:])], np.int64)
        self.n_repeat_words = self._repeats()
        self.failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def _repeats(self) -> np.ndarray:
        w, width = self.words, 5
        n = len(w.start)
        inside = np.zeros(n + 1, np.int64)
        if n >= width:
            starts = np.flatnonzero(w.doc[:n - width + 1] == w.doc[width - 1:])
            key = runs(w.hashes(), width, 31)[starts] ^ mix64(w.doc[starts].astype(np.uint64))
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            again = starts[count[which] > 1]
            np.add.at(inside, again, 1)
            np.add.at(inside, again + width, -1)
        return np.bincount(w.doc[np.cumsum(inside)[:n] > 0], minlength=len(w.first) - 1)


def _counts(batches):
    """(lang, word, class, n): what the kept documents of a batch hold."""
    for b in slices(batches):
        p = Profile(b.column("text"))
        w, langs = p.words, b.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero((lang == code) & ~p.failed)
            if not len(rows):
                continue
            totals = p.classes[rows].sum(0)
            texts = pc.fill_null(b.column("text").take(pa.array(rows)), "")
            lowered = pc.replace_substring_regex(pc.ascii_lower(texts), r"[ \t-\r]+", " ")
            said = pc.value_counts(pc.split_pattern(pc.utf8_trim(lowered, " "), " ").flatten())
            names = pa.concat_arrays([said.field("values").cast(pa.string()), pa.nulls(len(totals), pa.string())])
            n = np.r_[said.field("counts").to_numpy(), totals]
            at = np.r_[np.full(len(said), -1), np.arange(len(totals))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(n), pa.string()), names, pa.array(at), pa.array(n.astype(np.int64))],
                ["lang", "word", "class", "n"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts q; 0 for
    a row without counts."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    out = np.sqrt(np.clip(gain.sum(1) / 2, 0, 1))
    return np.round(np.where(total[:, 0] > 0, out, 0), 6)


def _judge(char_limit: float, word_limit: float, min_chars: int, min_words: int, min_reference: int):
    def run(batches):
        for b in slices(batches):
            p = Profile(b.column("text"))
            w = p.words
            hashes = w.hashes(lower=True)
            langs = b.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)
            by_char, by_word = np.zeros(len(lang)), np.zeros(len(lang))
            for code in range(len(langs.dictionary)):
                rows = np.flatnonzero(lang == code)
                ref = {c: b.column(c)[int(rows[0])].as_py() for c in ("common", "counts", "n_ref", "classes")}
                if ref["n_ref"] is None or ref["n_ref"] < min_reference:
                    continue
                by_char[rows] = distance(p.classes[rows], np.array(ref["classes"]))
                common = Words(pa.array(ref["common"])).hashes()
                order = np.argsort(common)
                at = np.minimum(np.searchsorted(common[order], hashes), len(common) - 1)
                bin_of = np.where(common[order][at] == hashes, order[at], len(common))
                mine = (lang == code)[w.doc]
                place = np.zeros(len(lang), np.int64)
                place[rows] = np.arange(len(rows))
                wide = len(common) + 1
                said = np.bincount(place[w.doc[mine]] * wide + bin_of[mine], minlength=len(rows) * wide)
                counts = np.array(ref["counts"])
                by_word[rows] = distance(said.reshape(len(rows), wide), np.r_[counts, ref["n_ref"] - counts.sum()])
            far = ((p.classes.sum(1) >= min_chars) & (by_char > char_limit)) | \
                ((p.n_words >= min_words) & (by_word > word_limit))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(x) for x in (
                    p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.failed,
                    ~p.failed & ~far, by_char, by_word)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                 "kept", "char_distance", "word_distance"])
    return run


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                  common: int = 50, char_limit: float = 0.25, word_limit: float = 0.5, min_chars: int = 200,
                  min_words: int = 50, min_reference: int = 1000) -> DataFrame:
    """Per document the counts of the base rules, base_failed, kept, and its
    distances from the language (0 where no reference judges it).

    ``common``: words of a reference; ``char_limit``, ``word_limit``: greatest
    distance that is kept; ``min_chars``, ``min_words``: least size that a
    histogram judges; ``min_reference``: least words of a reference."""
    scratch = Scratch()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(lang_column, F.lit("und")).alias("lang"),
                       F.col(text_column).alias("text"))
    counted = scratch.stored(
        rows.select("lang", "text").mapInArrow(_counts, "lang string, word string, class int, n long")
        .groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "counts")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.filter("word is not null").withColumn("nth", nth).filter(F.col("nth") <= common)
    ordered = F.sort_array(F.collect_list(F.struct("nth", "word", "n")))       # at most ``common`` entries
    classes = F.sort_array(F.collect_list(F.struct("class", "n")))             # one entry a class
    references = scratch.stored(
        top.groupBy("lang").agg(ordered.alias("top"))
        .join(counted.filter("word is null").groupBy("lang").agg(classes.alias("c")), "lang")
        .join(counted.filter("word is not null").groupBy("lang").agg(F.sum("n").alias("n_ref")), "lang")
        .select("lang", F.col("top.word").alias("common"), F.col("top.n").alias("counts"), "n_ref",
                F.col("c.n").alias("classes")), "references")
    # Spark broadcasts the references if their table is small, and else joins by sorting
    id_type = rows.schema["doc_id"].dataType.simpleString()
    judged = rows.join(references, "lang", "left").mapInArrow(
        _judge(char_limit, word_limit, min_chars, min_words, min_reference),
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, char_distance double, word_distance double")
    return scratch.result(judged, "judged")

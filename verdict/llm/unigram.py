"""SentencePiece encoding and decoding with a max-plus parallel scan.

A text is cut into the vocabulary's pieces of the greatest total score (what a
model of type unigram does). The best scores at a position are a max-plus linear
function of those at the positions before it, so a stretch of text is a matrix
from the states at its begin to the states at its end; the state at a boundary is
how far before it the last cut lies.

Documents of more than ``giant`` characters are split into chunks, each with its
transfer matrix. Matrices are combined associatively, ``fan`` chunks to a group and
then the groups of a document; the best scores ahead of every boundary follow. With
them each chunk says which state at its begin each state at its end leads back to;
these maps are combined in the same way from the end, and each
chunk is traced back by itself. Other documents are one chunk. Where no piece can
span a place (before a blank that follows no blank, in vocabularies whose pieces
have blanks at their begin only), the matrix is an outer sum, and equal stretches
between such places are solved once.

Characters without a piece cost ``unknown`` below the least score and come out as
their bytes' pieces, or as the unknown piece in models without them. Blanks are
written as U+2581, and a text begins with one; models with another normalisation
are refused. Decoding is exact, but for U+2581 in a text, which comes back as blank.

Nulls: a null or empty text has no pieces and decodes as empty. Repeated rows are
encoded each. Extra columns are kept, but ``ids`` and ``decoded`` are replaced. An empty
table gives an empty result. Equal scores: of the best cuttings up to a place, the one with
the longest last piece; this is the same in one chunk and in many, as scores are
multiples of 2**-20 (rounded, where a model has finer ones), whose sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import constants, mix64, slices

_U = np.uint64
BLANK = 0x2581
_STEP = int(constants(301, 1)[0])
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
FILTER_BITS = 18
NONE = -np.inf
QUANTUM = 1 << 20   # scores are multiples of its inverse: sums are exact in any order
_loaded: dict[str, Vocabulary] = {}


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Vocabulary:
    def __init__(self, path: str, unknown: float = 10.0):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("only models that keep texts as they are can be used")
        kinds = proto.ModelProto.SentencePiece
        scored = [(i, p.piece, round(p.score * QUANTUM) / QUANTUM) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.longest = max(len(p) for _, p, _ in scored)
        self.separable = all("▁" not in p.lstrip("▁") for _, p, _ in scored)
        self.unknown = min(s for _, _, s in scored) - unknown
        self.tables: list[tuple[np.ndarray, ...]] = []
        for size in range(1, self.longest + 1):
            own = [x for x in scored if len(x[1]) == size]
            h = self.hashes(points("".join(x[1] for x in own)))[size - 1][size - 1::size]
            order = np.argsort(h)
            seen = np.zeros(1 << FILTER_BITS, bool)   # most strings are no piece: seen here at once
            seen[h >> _U(64 - FILTER_BITS)] = True
            self.tables.append((seen, h[order], np.array([own[k][0] for k in order], np.int64),
                                np.array([own[k][2] for k in order], float)))
        # what each piece stands for
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes_of = np.array([byte_ids[b] for b in range(256)], np.int64) if len(byte_ids) == 256 else None
        self.unknown_id = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        value = {i: bytes([b]) for b, i in byte_ids.items()} | {i: p.replace("▁", " ").encode() for i, p, _ in scored}
        value[self.unknown_id] = " ⁇ ".encode()
        raw = [value.get(i, b"") for i in range(len(model.pieces))]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw])
        self.begin = np.cumsum(self.size) - self.size

    def hashes(self, x: np.ndarray) -> list[np.ndarray]:
        """By length, the hash of what ends at each place (wrapping at the begin)."""
        c = mix64(x.astype(np.uint64) + _U(977))
        out = [c]
        with np.errstate(over="ignore"):
            for _ in range(1, self.longest):
                out.append(np.r_[out[-1][:1], out[-1][:-1]] * _U(_STEP) + c)
        return out

    def matches(self, x: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) by length and place of the pieces that end at each place;
        ``room``: characters of the place's stretch up to it."""
        score, ids = np.full((self.longest, len(x)), NONE), np.zeros((self.longest, len(x)), np.int64)
        for k, (h, (seen, keys, piece, points_)) in enumerate(zip(self.hashes(x), self.tables)):
            if not len(keys):
                continue
            at = np.flatnonzero(seen[h >> _U(64 - FILTER_BITS)] & (room > k))
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[place] == h[at]
            score[k, at[hit]], ids[k, at[hit]] = points_[place[hit]], piece[place[hit]]
        lone = np.flatnonzero(score[0] == NONE)
        score[0, lone], ids[0, lone] = self.unknown, -1 - x[lone].astype(np.int64)
        return score, ids

    def spelled(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with those of unknown characters (-1 - character) as bytes;
        ``of`` says whose they are."""
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, of
        if self.bytes_of is None:
            ids = ids.copy()
            ids[lost] = self.unknown_id
            return ids, of
        spelled = [chr(-1 - i).encode() for i in ids[lost].tolist()]
        size = np.ones(len(ids), np.int64)
        size[lost] = [len(s) for s in spelled]
        out, begin = np.repeat(ids, size), np.cumsum(size) - size
        for k, s in zip(begin[lost].tolist(), spelled):
            out[k:k + len(s)] = self.bytes_of[list(s)]
        return out, np.repeat(of, size)


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def normalised(text: str | None) -> np.ndarray:
    return points("▁" + text.replace(" ", "▁")) if text else np.zeros(0, np.uint32)


def safe_places(v: Vocabulary, x: np.ndarray) -> np.ndarray:
    """Places at which every cutting has a cut."""
    if not v.separable:
        return np.zeros(0, np.int64)
    blank = x == BLANK
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def _reached(v: Vocabulary, x: np.ndarray, ahead: np.ndarray | None = None, before: int = 0):
    """(best, take, ids) over the places of one stretch: the best score up to each, the
    length of the last piece and its id. ``ahead``: the best scores of cuts 0, 1, ...
    places before place ``before``, on which the stretch begins."""
    score, ids = v.matches(x, np.arange(1, len(x) + 1))
    best, take = [NONE] * (len(x) + 1), [0] * (len(x) + 1)
    if ahead is None:
        best[0] = 0.0
    else:
        for i in range(min(before + 1, len(ahead))):
            best[before - i] = float(ahead[i])
    length, place = np.nonzero(score > NONE)
    order = np.lexsort((length, place))
    for k, p, s in zip(length[order].tolist(), (place[order] + 1).tolist(), score[length[order], place[order]].tolist()):
        if p > before and best[p - k - 1] + s >= best[p] and best[p - k - 1] > NONE:
            best[p], take[p] = best[p - k - 1] + s, k + 1
    return best, take, ids


def _back(take: list[int], ids: np.ndarray, end: int) -> list[int]:
    """Pieces on the way back from place ``end``."""
    out, p = [], end
    while take[p]:
        out.append(int(ids[take[p] - 1, p - 1]))
        p -= take[p]
    return out[::-1]


def _stretch(v: Vocabulary, x: np.ndarray) -> tuple[float, list[int]]:
    """The best cutting of one stretch."""
    if not len(x):
        return 0.0, []
    best, take, ids = _reached(v, x)
    return best[-1], _back(take, ids, len(x))


def _many(v: Vocabulary, x: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The best cuttings of stretches of ``x`` in step: (scores, counts, ids)."""
    n = len(first)
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(n), size)
    room = np.arange(len(own)) - begin[own] + 1
    score, ids = v.matches(x[first[own] + room - 1], room)
    slot = begin + np.arange(n)           # a place more for each stretch: its begin
    best, take = np.full(len(own) + n, NONE), np.zeros(len(own) + n, np.int64)
    best[slot] = 0.0
    order = np.argsort(size, kind="stable")
    until = np.searchsorted(size[order], np.arange(size.max(initial=0) + 1))
    for p in range(1, len(until)):
        live = order[until[p]:]
        at, here = begin[live] + p - 1, slot[live] + p
        top, length = np.full(len(live), NONE), np.zeros(len(live), np.int64)
        for k in range(min(p, v.longest)):
            value = best[here - k - 1] + score[k, at]
            better = (value >= top) & (value > NONE)
            top[better], length[better] = value[better], k + 1
        best[here], take[here] = top, length
    left, live, steps = size.copy(), np.arange(n), []
    counts = np.zeros(n, np.int64)
    while len(live):
        t = take[slot[live] + left[live]]
        steps.append((live, ids[t - 1, begin[live] + left[live] - 1]))
        counts[live] += 1
        left[live] -= t
        live = live[left[live] > 0]
    out, end = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts)
    for nth, (who, piece) in enumerate(steps):
        out[end[who] - 1 - nth] = piece
    return best[slot + size], counts, out


def best_pieces(v: Vocabulary, x: np.ndarray, first: np.ndarray, last: np.ndarray, group: int = 1 << 16, long: int = 256):
    """(scores, counts, ids) of the best cuttings of the stretches of ``x``;
    equal stretches are solved once."""
    size = last - first
    up, down = _powers(_STEP, len(x) + 1), _powers(_STEP_INVERSE, len(x) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[_U(0), np.cumsum(mix64(x.astype(np.uint64) + _U(977)) * up[:-1], dtype=np.uint64)]
        key = mix64((total[last] - total[first]) * down[first]) ^ mix64(size.astype(np.uint64))
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    scores, counts = np.zeros(len(one)), np.zeros(len(one), np.int64)
    pieces: list = [None] * len(one)
    for u in np.flatnonzero(size[one] > long):
        scores[u], found = _stretch(v, x[first[one[u]]:last[one[u]]])
        counts[u], pieces[u] = len(found), np.array(found, np.int64)
    short = np.flatnonzero(size[one] <= long)
    cuts = np.flatnonzero(np.diff(np.cumsum(size[one[short]]) // group)) + 1
    flat = [np.zeros(0, np.int64)]
    for part in np.split(short, cuts):
        if len(part):
            scores[part], counts[part], found = _many(v, x, first[one[part]], size[one[part]])
            flat.append(found)
    begin = np.zeros(len(one), np.int64)
    begin[short] = np.cumsum(counts[short]) - counts[short]
    at = sum(map(len, flat))
    for u in np.flatnonzero(size[one] > long):
        begin[u], at = at, at + len(pieces[u])
        flat.append(pieces[u])
    ids, n = np.concatenate(flat), counts[of]
    ids = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[of], n)]
    return scores[of], n, ids


def _encode_batch(v: Vocabulary, texts: list[str | None]) -> list[bytes]:
    xs = [normalised(t) for t in texts]
    x = np.concatenate(xs) if xs else np.zeros(0, np.uint32)
    ends = np.cumsum([len(y) for y in xs])
    starts = ends - [len(y) for y in xs]
    first = np.union1d(safe_places(v, x), starts[starts < ends])
    of = np.searchsorted(starts, first, "right") - 1
    last = np.r_[first[1:], len(x)]
    # rows without text share their begin with the next row
    _, n, ids = best_pieces(v, x, first, last)
    ids, of = v.spelled(ids, np.repeat(of, n))
    cut = np.searchsorted(of, np.arange(len(xs) + 1))
    raw = ids.astype("<u4").tobytes()
    return [raw[4 * a:4 * z] for a, z in zip(cut[:-1], cut[1:])]


def _encode(path: str):
    def run(batches):
        for b in slices(batches, max_bytes=1 << 20):
            ids = _encode_batch(vocabulary(path), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, "ids"])
    return run


def _split(path: str, chunk: int):
    """Chunks of normalised texts, each with the characters before it that a
    piece over its begin may need."""
    def run(batches):
        for b in slices(batches, max_bytes=1 << 20):
            before = vocabulary(path).longest - 1
            rows = []
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text").to_pylist()):
                x = normalised(text)
                n = max(1, len(x) // chunk)   # the last one is longer, so that no chunk is shorter than a piece
                for k in range(n):
                    s, e = k * chunk, len(x) if k == n - 1 else (k + 1) * chunk
                    c = max(0, s - before)
                    rows.append((uid, k, k == n - 1, s - c, x[c:e].tobytes().decode("utf-32-le")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()))],
                ["uid", "chunk", "final", "before", "body"])
    return run


def transfer(v: Vocabulary, x: np.ndarray, before: int, final: bool) -> np.ndarray:
    """The chunk's matrix: from the last cut i places before its begin to the
    last cut j places before its end (only 0 in the last chunk)."""
    n, size = v.longest, len(x)
    safe = safe_places(v, x)
    safe = safe[safe > before]
    out = np.full((n, n), NONE)
    stop = int(safe[0]) if len(safe) else size
    # one best score for each begin i, over the first stretch
    score, _ = v.matches(x[:stop], np.arange(1, stop + 1))
    best = np.full((stop + 1, n), NONE)
    for i in range(min(before, n - 1) + 1):
        best[before - i, i] = 0.0
    for p in range(before + 1, stop + 1):
        k = np.flatnonzero(score[:p, p - 1] > NONE)
        best[p] = np.maximum(best[p], (best[p - 1 - k] + score[k, p - 1][:, None]).max(0, initial=NONE))
    if not len(safe):
        for j in range(1 if final else n):
            if size - j > before:
                out[:, j] = best[size - j]
        return out
    z = int(safe[-1])
    middle = best_pieces(v, x, safe[:-1], safe[1:])[0].sum() if len(safe) > 1 else 0.0
    for j in range(1 if final else min(n, size - z + 1)):
        out[:, j] = best[stop] + middle + _stretch(v, x[z:size - j])[0]
    return out


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: one stretch after the other."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scores_ahead(matrices: list[np.ndarray], ahead: np.ndarray) -> list[np.ndarray]:
    """The best scores of the states at each matrix's begin."""
    out = [ahead]
    for m in matrices[:-1]:
        out.append((out[-1][:, None] + m).max(0))
    return out


def ways_back(v: Vocabulary, x: np.ndarray, before: int, final: bool, ahead: np.ndarray) -> np.ndarray:
    """By state at the chunk's end, the state at its begin that the best way
    leads back to (0 for states that no way reaches)."""
    safe = safe_places(v, x)
    safe = safe[safe > before]
    stop = int(safe[0]) if len(safe) else len(x)
    best, take, _ = _reached(v, x[:stop], ahead, before)
    root = list(range(stop + 1))
    for p in range(before + 1, stop + 1):
        root[p] = root[p - take[p]] if take[p] else before
    ends = [stop] * v.longest if len(safe) else [max(stop - j, before) for j in range(v.longest)]
    return np.array([before - root[e] if best[e] > NONE else 0 for e in ends], np.int32)


def _matrices(path: str):
    def run(batches):
        v = None
        for b in slices(batches, "body", 1 << 20):
            v = v or vocabulary(path)
            m = [transfer(v, points(t), before, final).tobytes() for t, before, final in
                 zip(b.column("body").to_pylist(), b.column("before").to_pylist(), b.column("final").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("chunk"), pa.array(m, pa.binary())], ["uid", "chunk", "matrix"])
    return run


def _runs(batches, names, keys: int):
    """Rows of a sorted input, run by run of their first ``keys`` columns."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in names)):
            if held and held[0][:keys] != r[:keys]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw)
    return m.reshape(int(len(m) ** 0.5), -1)


def _products(batches):
    for run in _runs(batches, ("uid", "group", "chunk", "matrix"), 2):
        m = _square(run[0][3])
        for r in run[1:]:
            m = combined(m, _square(r[3]))
        yield pa.RecordBatch.from_pydict({"uid": [run[0][0]], "group": [run[0][1]], "matrix": [m.tobytes()]})


def _ahead_of_groups(batches):
    for run in _runs(batches, ("uid", "group", "matrix"), 1):
        m = [_square(r[2]) for r in run]
        values = scores_ahead(m, np.where(np.arange(len(m[0])) == 0, 0.0, NONE))
        yield pa.RecordBatch.from_pydict({"uid": [r[0] for r in run], "group": [r[1] for r in run],
                                          "ahead": [a.tobytes() for a in values]})


def _ahead_of_chunks(batches):
    for run in _runs(batches, ("uid", "group", "chunk", "matrix", "ahead"), 2):
        values = scores_ahead([_square(r[3]) for r in run], np.frombuffer(run[0][4]))
        yield pa.RecordBatch.from_pydict({"uid": [r[0] for r in run], "chunk": [r[2] for r in run],
                                          "ahead": [a.tobytes() for a in values]})


def _ways(path: str):
    def run(batches):
        v = None
        for b in slices(batches, "body", 1 << 20):
            v = v or vocabulary(path)
            way = [ways_back(v, points(t), before, final, np.frombuffer(ahead)).tobytes() for t, before, final, ahead in
                   zip(*(b.column(c).to_pylist() for c in ("body", "before", "final", "ahead")))]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("chunk"), pa.array(way, pa.binary())], ["uid", "chunk", "way"])
    return run


def _way(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def _ways_of_groups(batches):
    for run in _runs(batches, ("uid", "group", "chunk", "way"), 2):
        way = _way(run[-1][3])
        for r in reversed(run[:-1]):
            way = _way(r[3])[way]
        yield pa.RecordBatch.from_pydict({"uid": [run[0][0]], "group": [run[0][1]], "way": [way.tobytes()]})


def _leaves(ways: list[bytes], leave: int) -> list[int]:
    """States at the ends of consecutive stretches, of which the last is left at ``leave``."""
    out = [leave]
    for way in reversed(ways[1:]):
        out.append(int(_way(way)[out[-1]]))
    return out[::-1]


def _leaves_of_groups(batches):
    for run in _runs(batches, ("uid", "group", "way"), 1):
        yield pa.RecordBatch.from_pydict({"uid": [r[0] for r in run], "group": [r[1] for r in run],
                                          "leave": _leaves([r[2] for r in run], 0)})


def _leaves_of_chunks(batches):
    for run in _runs(batches, ("uid", "group", "chunk", "way", "leave"), 2):
        yield pa.RecordBatch.from_pydict({"uid": [r[0] for r in run], "chunk": [r[2] for r in run],
                                          "leave": _leaves([r[3] for r in run], run[0][4])})


def traced(v: Vocabulary, x: np.ndarray, before: int, ahead: np.ndarray, leave: int) -> np.ndarray:
    """Pieces of a chunk that is left at state ``leave``, from the best scores ahead of it."""
    x = x[:len(x) - leave]
    safe = safe_places(v, x)
    safe = safe[safe > before]
    stop = int(safe[0]) if len(safe) else len(x)
    _, take, ids = _reached(v, x[:stop], ahead, before)
    out = np.array(_back(take, ids, stop), np.int64)
    if len(safe):
        out = np.concatenate([out, best_pieces(v, x, safe, np.r_[safe[1:], len(x)])[2]])
    return v.spelled(out, np.zeros(len(out), np.int64))[0]


def _trace(path: str):
    def run(batches):
        for b in slices(batches, "body", 1 << 20):
            ids = [traced(vocabulary(path), points(t), before, np.frombuffer(ahead), leave).astype("<u4").tobytes()
                   for t, before, ahead, leave in
                   zip(*(b.column(c).to_pylist() for c in ("body", "before", "ahead", "leave")))]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("chunk"), pa.array(ids, pa.binary())], ["uid", "chunk", "ids"])
    return run


def _join_parts(batches):
    for b in batches:
        for uid, parts in zip(b.column("uid").to_pylist(), b.column("parts").to_pylist()):
            yield pa.RecordBatch.from_pydict({"uid": [uid], "ids": [b"".join(p["ids"] for p in parts)]})


def _plainly_named(df: DataFrame, keep: str) -> DataFrame:
    """df with all columns but ``keep`` renamed, so that none clashes or holds a dot."""
    return df.toDF(*[c if c == keep else f"c{i}" for i, c in enumerate(df.columns)])


def _encode_giants(docs: DataFrame, path: str, chunk: int, fan: int) -> DataFrame:
    docs = stored(docs.withColumn("uid", F.monotonically_increasing_id()), "giants")
    chunks = stored(docs.select("uid", "text").mapInArrow(
        _split(path, chunk), "uid long, chunk long, final boolean, before long, body string"), "chunks")
    spread = chunks.repartition("uid", "chunk")
    group = F.floor(F.col("chunk") / fan).alias("group")

    def sorted_by(df, *keys, last):
        return df.repartition(*keys).sortWithinPartitions(*keys, last)

    matrices = stored(spread.mapInArrow(_matrices(path), "uid long, chunk long, matrix binary").select("uid", group, "chunk", "matrix"), "matrices")
    products = sorted_by(matrices, "uid", "group", last="chunk").mapInArrow(_products, "uid long, group long, matrix binary")
    ahead_of_groups = sorted_by(products, "uid", last="group").mapInArrow(_ahead_of_groups, "uid long, group long, ahead binary")
    ahead = sorted_by(matrices.join(ahead_of_groups, ["uid", "group"]), "uid", "group", last="chunk").mapInArrow(
        _ahead_of_chunks, "uid long, chunk long, ahead binary")
    entered = stored(chunks.join(ahead, ["uid", "chunk"]), "entered")
    ways = stored(entered.repartition("uid", "chunk").mapInArrow(_ways(path), "uid long, chunk long, way binary")
                  .select("uid", group, "chunk", "way"), "ways")
    ways_of_groups = sorted_by(ways, "uid", "group", last="chunk").mapInArrow(_ways_of_groups, "uid long, group long, way binary")
    leaves = sorted_by(ways_of_groups, "uid", last="group").mapInArrow(_leaves_of_groups, "uid long, group long, leave long")
    states = sorted_by(ways.join(leaves, ["uid", "group"]), "uid", "group", last="chunk").mapInArrow(
        _leaves_of_chunks, "uid long, chunk long, leave long")
    parts = entered.join(states, ["uid", "chunk"]).mapInArrow(_trace(path), "uid long, chunk long, ids binary")
    whole = (parts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
             .mapInArrow(_join_parts, "uid long, ids binary"))
    return docs.join(whole, "uid").drop("uid")


def encode(docs: DataFrame, path: str, giant: int = 65_536, chunk: int = 16_384, fan: int = 64) -> DataFrame:
    """``docs`` (text, more) with ``ids``: little-endian unsigned 32-bit ids.
    ``giant``: characters from which a text is split into chunks of ``chunk``; the ids are the same for any."""
    docs = docs.drop("ids")
    names, docs = docs.columns, _plainly_named(docs, "text")
    large = F.coalesce(F.length("text") >= giant, F.lit(False))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    plain = docs.filter(~large).mapInArrow(_encode(path), f"{types}, ids binary")
    return plain.unionByName(_encode_giants(docs.filter(large), path, chunk, fan)).toDF(*names, "ids")


def _decode(path: str):
    def run(batches):
        for b in slices(batches, "ids", 1 << 20):
            v = vocabulary(path)
            raw = b"".join(r or b"" for r in b.column("ids").to_pylist())
            n = pc.fill_null(pc.binary_length(b.column("ids")), 0).to_numpy(zero_copy_only=False) // 4
            ids = np.frombuffer(raw, "<u4").astype(np.int64)
            size = v.size[ids]
            out = v.raw[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - v.begin[ids], size)].tobytes()
            ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n)]]
            # every text begins with a blank of its own
            text = [out[a + (out[a:a + 1] == b" "):z].decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])
    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (ids, more) with ``decoded``, the text of the ids."""
    rows = rows.drop("decoded")
    names, rows = rows.columns, _plainly_named(rows, "ids")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_decode(path), f"{types}, decoded string").toDF(*names, "decoded")

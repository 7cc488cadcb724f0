"""Best-fit packing of token sequences by a configuration linear program.

1. Documents become pieces of at most ``capacity`` tokens; only the histogram
   of piece lengths (at most ``capacity`` numbers, whatever the data) comes to
   the driver.
2. Configurations are multisets of lengths that fit one sequence. The covering
   program (fewest configurations that cover the histogram) is solved by
   multiplicative weights: each round prices the lengths, finds the best
   configuration by a knapsack dynamic program, and lowers the weights of
   the lengths it covers. Weights start a little above the share of a sequence for
   long pieces, so that short ones are not used up while long ones still need them.
3. The fractional solution is rounded down to whole configurations, as often as
   pieces are left for them, and the program is solved again for the rest, ``solves``
   times in all. What is then left over is packed best-fit decreasing, on counts,
   into the room that is left and into new sequences.
4. Each piece gets its rank among the pieces of its length (two-level, salted,
   so no length has to fit a task) and looks its place up in the plan.

Nulls: a null text is empty and so only the end token. Repeated rows are packed
as rows of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .words import slices

_encodings: dict = {}


def _encoding(vocabulary: str, pattern: str, special: dict[str, int]):
    """Byte-level BPE of a ranks file; built once per worker."""
    if vocabulary not in _encodings:
        import tiktoken
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[vocabulary]


_tokenizers: dict[str, object] = {}


def _ids(text: str, vocabulary: str, pattern: str, special: dict[str, int], whole: str | None) -> list[int]:
    """A text's ids. The ranks' pattern gives up on runs of some 100,000 blanks; the
    same vocabulary's own tokenizer (``whole``) takes them, slower."""
    try:
        return _encoding(vocabulary, pattern, special).encode(text, allowed_special="all")
    except ValueError:
        if whole is None:
            raise
        if whole not in _tokenizers:
            from tokenizers import Tokenizer
            _tokenizers[whole] = Tokenizer.from_file(whole)
        return _tokenizers[whole].encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int,
                 special: dict[str, int] | None = None, whole: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every text and
    ``end_id``, cut to ``capacity``; a longer document's first piece takes the
    remainder. ids: little-endian unsigned 32-bit. ``special``: strings that are one
    token wherever a text has them."""
    special = special or {}

    def run(batches):
        for b in slices(batches, max_bytes=1 << 20):
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = np.array(_ids(text or "", vocabulary, pattern, special, whole) + [end_id], "<u4").tobytes()
                n = len(raw) // 4
                a, z = 0, n % capacity or capacity
                while a < n:
                    row.append(i), piece.append(len(ids) if not a else piece[-1] + 1)
                    if not a:
                        piece[-1] = 0
                    start.append(a), length.append(z - a), ids.append(raw[4 * a:4 * z])
                    a, z = z, z + capacity
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _best_configuration(price: np.ndarray, capacity: int) -> Counter:
    """Unbounded knapsack: the multiset of lengths of the greatest price."""
    lengths = np.flatnonzero(price)
    worth = price[lengths]
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, "right")
        best[c], take[c] = best[c - 1], 0
        if k:
            v = worth[:k] + best[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], take[c] = v[j], lengths[j]
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if take[c]:
            out[int(take[c])] += 1
            c -= int(take[c])
        else:
            c -= 1
    return out


def fractional_cover(counts: np.ndarray, capacity: int, rounds: int = 400, rate: float = 0.02, longer: float = 0.1):
    """Multiplicative weights on the covering program: configurations, the amount
    of each, and that amount over the load of the most covered of its lengths, by
    which no length is covered more than once."""
    need = np.flatnonzero(counts)
    part = need / capacity
    load = np.zeros(capacity + 1)
    weight = np.zeros(capacity + 1)
    weight[need] = (part + longer * part ** 2) * counts[need]
    seen: dict[tuple, float] = {}
    for _ in range(rounds if len(need) else 0):
        price = np.zeros(capacity + 1)
        price[need] = weight[need] / counts[need]
        c = _best_configuration(price, capacity)
        if not c:
            break
        lengths = np.fromiter(c, np.int64)
        times = np.fromiter(c.values(), np.int64)
        amount = (counts[lengths] / times).min()   # fills its scarcest length once
        seen[tuple(sorted(c.items()))] = seen.get(tuple(sorted(c.items())), 0.0) + amount
        covered = amount * times / counts[lengths]
        load[lengths] += covered
        weight[lengths] *= (1 - rate) ** covered
    return [(dict(c), x, x / max(1.0, max(load[l] for l, _ in c))) for c, x in seen.items()]


def plan_sequences(counts: np.ndarray, capacity: int, solves: int = 3) -> list[tuple[dict[int, int], int]]:
    """Whole configurations (lengths with multiplicity, how often) that use
    every piece of the histogram exactly once. The fractional solution is rounded
    in two ways, by its scaled amounts, and by its whole amounts as far as pieces
    are left, then those of its residuals; the one with fewest sequences is taken."""
    cover = sorted(fractional_cover(counts.astype(float), capacity), key=lambda c: -c[1])
    plans = [_rounded(counts, capacity, [(c, int(x + up)) for c, _, x in cover]) for up in (0, 0.5, 0.999)]
    left, taken = counts.astype(np.int64), []
    for solve in range(solves):
        if solve:
            cover = sorted(fractional_cover(left.astype(float), capacity), key=lambda c: -c[1])
        for c, x, _ in cover:
            times = min(int(x), int(min(left[l] // k for l, k in c.items())))
            if times:
                taken.append((c, times))
                for l, k in c.items():
                    left[l] -= k * times
    plans.append(_rounded(counts, capacity, taken))
    return min(plans, key=lambda p: sum(n for _, n in p))


def _rounded(counts: np.ndarray, capacity: int, cover) -> list[tuple[dict[int, int], int]]:
    left = counts.astype(np.int64).copy()
    bins: Counter = Counter()

    def use(config: dict[int, int], times: int) -> None:
        if times > 0:
            bins[tuple(sorted(config.items()))] += times
            for l, k in config.items():
                left[l] -= k * times

    for config, x in cover:
        use(config, min(x, int(min(left[l] // k for l, k in config.items()))))
    # best-fit decreasing on counts: open sequences by the room they have
    rooms: dict[int, Counter] = {}
    for config, times in bins.items():
        rooms.setdefault(capacity - sum(l * k for l, k in config), Counter())[config] += times

    def add(config: tuple, l: int, k: int) -> tuple:
        c = Counter(dict(config))
        c[l] += k
        return tuple(sorted(c.items()))

    for l in range(capacity, 0, -1):
        while left[l]:
            room = min((r for r in rooms if r >= l), default=None)
            if room is None:
                k = capacity // l
                whole, rest = divmod(int(left[l]), k)
                for n, times in ((k, whole), (rest, 1)):
                    if n and times:
                        rooms.setdefault(capacity - n * l, Counter())[((l, n),)] += times
                left[l] = 0
                break
            config, times = next(iter(rooms[room].items()))
            k = min(room // l, int(left[l]))
            n = min(times, int(left[l]) // k)
            rooms[room][config] -= n
            if not rooms[room][config]:
                del rooms[room][config]
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - k * l, Counter())[add(config, l, k)] += n
            left[l] -= k * n
    return [(dict(c), n) for group in rooms.values() for c, n in group.items()]


def _places(plan: list[tuple[dict[int, int], int]], capacity: int):
    """The plan as arrays sorted by length and first rank: pieces of a length
    with ranks from ``rank`` on lie ``k`` to a sequence from ``sequence`` on,
    the first at ``offset``."""
    rows, at, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for config, times in plan:
        offset = 0
        for l, k in sorted(config.items(), reverse=True):
            rows.append((l, at[l], k, sequence, offset))
            at[l] += k * times
            offset += l * k
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(pieces: DataFrame, capacity: int, salts: int = 256) -> DataFrame:
    """``pieces`` (doc_id, piece, length, more) with ``sequence_id`` and
    ``offset``. Pieces are read several times: give a stored table.

    ``salts``: parts that each length is ranked in."""
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece, start), {salts})"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).take(capacity):  # one row a length
        counts[r["length"]] = r["n"]
    table = _places(plan_sequences(counts, capacity), capacity)
    before = sizes.select("length", "salt", (F.sum("n").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = (salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)
        .join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt"))
    names = ranked.columns
    radix = int(counts.max(initial=0)) + 1
    keys = table[:, 0] * radix + table[:, 1]

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            t = table[np.searchsorted(keys, length * radix + rank, "right") - 1]
            nth = rank - t[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(t[:, 3] + nth // t[:, 2]), pa.array(t[:, 4] + nth % t[:, 2] * length)],
                [*names, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    return ranked.mapInArrow(place, f"{types}, sequence_id long, offset long").drop("rank")

"""Best-fit packing: Martello-Toth dominance reduction of the histogram of piece lengths, then best fit for the rest."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import words
from kerbline.llm.common import resident, written
from kerbline.llm.encoding import ChunkEncoder, opened
from kerbline.operators import ordered

SEQUENCE = 2048
END_ID = 0
OUT_BYTES = 8 << 20


def encoder(path: str) -> ChunkEncoder:
    return resident(f"chunks {path}", lambda: ChunkEncoder(path))


class Bins:
    """Equal bins together: how often each content stands, and where each copy of a length is put.

    ``runs`` are (length, first copy, copies in a bin, first bin, offset of the first one): copy k of that run, from 0,
    goes to bin ``first bin + k // copies in a bin``, at ``offset + k % copies * length``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = {}

    def put(self, length: int, copies: int, each: int, first_bin: int, offset: int) -> None:
        """Copies of a length into bins from ``first_bin``, ``each`` in a bin."""
        done = self.used.get(length, 0)
        self.runs.append((length, done, each, first_bin, offset))
        self.used[length] = done + copies

    def fix(self, content: list[int], times: int) -> None:
        """Bins of one content."""
        offset = 0
        for length in dict.fromkeys(content):
            each = content.count(length)
            self.put(length, times * each, each, self.bins, offset)
            offset += each * length
        self.bins += times


def dominating_set(j: int, sizes: list[int], counts: dict[int, int], capacity: int) -> list[int] | None:
    """A set with the length j that dominates every other set with it, or None.

    A set dominates another if the other's lengths can be shared out among its members without exceeding any.
    ``sizes`` are the lengths left, ascending; ``counts`` how often each is left, j not taken off yet.
    """

    def largest(most: int, taken: tuple[int, ...]) -> int | None:
        at = bisect_right(sizes, most) - 1
        while at >= 0 and counts[sizes[at]] <= taken.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else None

    def smallest(n: int, above: int, taken: tuple[int, ...]) -> list[int]:
        """The n smallest lengths over ``above`` that are left beside ``taken``."""
        out, at = [], bisect_right(sizes, above)
        while at < len(sizes) and len(out) < n:
            out += [sizes[at]] * min(n - len(out), counts[sizes[at]] - taken.count(sizes[at]))
            at += 1
        return out

    room = capacity - j
    k = largest(room, (j,))
    if k is None:
        return [j]
    low = smallest(3, 0, (j,))
    if k == room or len(low) < 2 or sum(low[:2]) > room:
        return [j, k]  # k fills the bin, or only one more fits: all that may stand beside j is at most k
    if len(low) == 3 and sum(low) <= room:
        return None
    # at most two more fit: beside k goes b, and another pair p >= q is dominated if q <= b
    b = largest(room - k, (j, k))
    if b is None:
        best = 0  # no pair holds k: is the largest pair at most k?
        for p in reversed(sizes[: bisect_left(sizes, k)]):
            q = largest(min(p, room - p), (j, p))
            best = max(best, p + q if q is not None else 0)
        return [j, k] if best <= k else None
    over = smallest(2, b, (j,))
    return [j, k, b] if len(over) < 2 or sum(over) > room else None


def reduce_by_dominance(counts: dict[int, int], bins: Bins) -> dict[int, int]:
    """Fix dominating sets for good, longest lengths first and again until none is found; what is left is the smaller instance.

    Every fix uses up a length or leaves fewer than its set needs, so fixes are as few as lengths, not as pieces.
    """
    counts = {s: n for s, n in counts.items() if n}
    sizes, again = sorted(counts), True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                content = dominating_set(j, sizes, counts, bins.capacity)
                if content is None:
                    break
                times = min(counts[s] // content.count(s) for s in content)
                bins.fix(content, times)
                again = True
                for s in content:
                    counts[s] -= times
                for s in set(content):
                    if not counts[s]:
                        del counts[s]
                        sizes.remove(s)
    return counts


def best_fit(counts: dict[int, int], bins: Bins) -> None:
    """Best fit of lengths in descending order, equal bins at once: a length goes to the fullest bins that have room for it."""
    open_bins: dict[int, list[list[int]]] = {}  # room left: [first bin, how many]
    rooms: list[int] = []

    def leave(room: int, first: int, times: int) -> None:
        if times and room:
            if room not in open_bins:
                rooms.insert(bisect_left(rooms, room), room)
                open_bins[room] = []
            open_bins[room].append([first, times])

    def fill(size: int, left: int, room: int, first: int, times: int) -> int:
        """Into bins of one room; returns how many bins were taken."""
        each = room // size
        whole = min(times, left // each)
        if whole:
            bins.put(size, whole * each, each, first, bins.capacity - room)
            leave(room - each * size, first, whole)
        rest = left - whole * each
        if whole < times and rest:
            rest = min(rest, each)
            bins.put(size, rest, rest, first + whole, bins.capacity - room)
            leave(room - rest * size, first + whole, 1)
            return whole + 1
        return whole

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = bins.capacity // size
                need = -(-left // each)
                first, bins.bins = bins.bins, bins.bins + need
                fill(size, left, bins.capacity, first, need)
                break
            room = rooms[at]
            first, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            taken = fill(size, left, room, first, times)
            leave(room, first + taken, times - taken)
            left -= min(left, taken * (room // size))


def packed_bins(counts: dict[int, int], capacity: int = SEQUENCE) -> Bins:
    """Where the copies of each length go.  Work and result grow with the number of lengths (at most ``capacity``), not of pieces."""
    bins = Bins(capacity)
    best_fit(reduce_by_dominance(counts, bins), bins)
    return bins


def pieces(docs: DataFrame, tokenizer: str, sequence: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32, ids of every document; a longer one is cut, and its first piece may be shorter."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        for batch in batches:
            own = batch.column("id")
            for at, to, data, offsets in words.pieces(batch, "text"):
                ids, places = opened(made.encode(data, offsets), made.kind)
                # a document's pieces, the shorter one first
                size = np.diff(places)
                number = -(-size // sequence)
                owner = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                end = places[1:][owner] - (number[owner] - 1 - piece) * sequence
                start = np.maximum(end - sequence, places[:-1][owner])
                wide = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist())]
                cuts = pa.py_buffer((np.r_[start, end[-1:]] * made.width).astype(np.int32))  # pieces lie end to end
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(at + owner)), pa.array(piece.astype(np.int32)), pa.array(start - places[:-1][owner]), pa.array(end - start),
                     pa.array(sums, pa.int64()), pa.Array.from_buffers(pa.binary(), len(owner), [None, cuts, pa.py_buffer(ids)])],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in as few sequences of ``sequence`` ids as can be: id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    ``ids`` are unsigned, little-endian, 2 bytes each if the vocabulary allows.  Only how often each length occurs
    reaches the driver, at most ``sequence`` numbers; there small sets that dominate all alternatives are fixed and
    the rest is put where it fits best, equal pieces at once.  Copies of a length are numbered over range slices, so
    a length may hold any share of all pieces, and each copy finds its place in the table of runs.

    Defined cases: a null text is an empty one and has the end id only; repeated rows are documents of their own; a
    null id is kept; an empty table gives no pieces; other columns are ignored.
    """
    made = written(pieces(docs, tokenizer, sequence, id_col, text_col))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(packed_bins(counts, sequence).runs), np.int64).reshape(-1, 5)
    placed = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by the number of lengths
    numbered = ordered.scan(made, ["id", "piece", "ids_crc32"], ["length"], sums={"copy": F.lit(1).cast("long")})
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = placed.value
        keys = run[:, 0] << 44 | run[:, 1]
        for batch in batches:
            length, copy = batch.column("length").to_numpy(), batch.column("copy").to_numpy() - 1
            own = run[np.searchsorted(keys, length << 44 | copy, "right") - 1]
            k = copy - own[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")],
                 pa.array(own[:, 3] + k // own[:, 2]), pa.array(own[:, 4] + k % own[:, 2] * length), batch.column("ids")],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"],
            )

    return numbered.select("id", "piece", "start", "length", "ids_crc32", "ids", "copy").mapInArrow(
        place, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    )

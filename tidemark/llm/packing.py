"""Packing of token sequences into as few training sequences as possible.

Documents of equal length are alike to a packing, so the plan works on counts by length: at most one number a token
length, whatever the corpus. Every piece starts alone in a bin, and swap-based local search does the packing: moves,
one-for-one and two-for-one exchanges from an emptier bin to one at least as full, each of which raises the sum of
squared fill, until bins empty and no exchange is left. Bins alike are exchanged together. Pieces in order of length
find their places in the plan by their place in that order, which Spark makes by range partitions, so no length's
pieces meet in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .batches import schema_of, tidy
from .places import with_places
from .shared import cut
from .tokens import SLICE_BYTES, encoder, vocabulary

Bin = tuple[tuple[int, int], ...]


def fill(held: Bin) -> int:
    return sum(length * n for length, n in held)


def _exchanged(held: Bin, gives: tuple[int, ...], takes: tuple[int, ...]) -> Bin:
    items = Counter(dict(held))
    items.subtract(gives)
    items.update(takes)
    return tuple(sorted(((length, n) for length, n in items.items() if n), reverse=True))


def _choices(held: Bin) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Each piece and each two pieces of a bin, with their sum."""
    for i, (a, n) in enumerate(held):
        yield a, (a,)
        for b, _ in held[i:]:
            if a != b or n > 1:
                yield a + b, (a, b)


class _Donors:
    """Bins by the pieces, and the sums of two pieces, that they can give; the set bits of a number are the sizes there are."""

    def __init__(self) -> None:
        self.held: set[Bin] = set()
        self.bits = [0, 0]
        self.queues: list[dict[int, list[tuple[int, Bin, tuple[int, ...]]]]] = [{}, {}]

    def add(self, held: Bin) -> None:
        if held not in self.held:
            self.held.add(held)
            full = fill(held)
            for size, items in _choices(held):
                k = len(items) - 1
                heappush(self.queues[k].setdefault(size, []), (full, held, items))
                self.bits[k] |= 1 << size

    def drop(self, held: Bin) -> None:
        self.held.discard(held)

    def largest(self, pieces: int, low: int, most: int, but: Bin | None) -> tuple[int, tuple[int, ...], Bin | None]:
        """The largest size over low and up to most of that many pieces, the pieces, and the emptiest bin that has it, other than but."""
        k = pieces - 1
        bits = self.bits[k] & ((2 << most) - 1)
        while (size := bits.bit_length() - 1) > low:
            queue, aside = self.queues[k][size], []
            while queue and (queue[0][1] == but or queue[0][1] not in self.held):
                aside.append(heappop(queue))
            found = queue[0] if queue else None
            for entry in aside:
                if entry[1] in self.held:
                    heappush(queue, entry)
            if found:
                return size, found[2], found[1]
            if not queue:
                self.bits[k] ^= 1 << size
            bits ^= 1 << size
        return low, (), None


class SwapSearch:
    """Local search over bins, of which those alike are one entry with a count.

    A pass goes from the fullest underfull bin to the emptiest. Each takes, of all exchanges of three pieces or fewer
    with bins at most as full, the one that closes most of its gap (a move takes as many equal pieces as fit), as often
    as both bins stand. A bin for which there is none has had its turn. Passes go on until one makes no exchange: then
    no single exchange of these kinds raises the sum of squared fill (a local optimum). They end before that where the
    bins are as few as their tokens allow, since no exchange can empty another then. Nothing else ends them.
    """

    def __init__(self, bins: Counter[Bin], capacity: int) -> None:
        self.capacity, self.exchanges = capacity, 0
        self.full = Counter({b: n for b, n in bins.items() if fill(b) == capacity})
        self.under = Counter({b: n for b, n in bins.items() if fill(b) < capacity})
        self.spare = self.under.total() * capacity - sum(fill(b) * n for b, n in self.under.items())

    def run(self) -> Counter[Bin]:
        while self.spare >= self.capacity and self._pass():
            pass
        return self.full + self.under

    def _pass(self) -> bool:
        """Whether there was an exchange. spare is the room in all bins; under one bin's room, none can become empty."""
        before = self.exchanges
        self.donors, todo, done = _Donors(), [(-fill(b), b) for b in self.under], []
        for _, b in todo:
            self.donors.add(b)
        heapify(todo)
        while todo and self.spare >= self.capacity:
            taker = heappop(todo)[1]
            if not self.under[taker]:
                continue
            while done and done[0][0] < -fill(taker):
                self.donors.drop(heappop(done)[1])
            gives, takes, giver = self._best(taker)
            if giver is None:
                heappush(done, (-fill(taker), taker))  # can still give to those at least as full
                continue
            for b in self._exchange(taker, gives, takes, giver):
                if self.under[b]:
                    self.donors.add(b)
                    heappush(todo, (-fill(b), b))
        return self.exchanges > before

    def _best(self, taker: Bin) -> tuple[tuple[int, ...], tuple[int, ...], Bin | None]:
        """(pieces to give, pieces to take, from which bin) for the largest gain that the gap holds."""
        gap = self.capacity - fill(taker)
        best, gain, but = ((), (), None), 0, taker if self.under[taker] == 1 else None
        for given, gives in ((0, ()), *_choices(taker)):
            for pieces in range(1, min(2, 3 - len(gives)) + 1):
                size, takes, giver = self.donors.largest(pieces, given + gain, given + gap, but)
                if giver is not None:
                    best, gain = (gives, takes, giver), size - given
            if gain == gap:
                break
        gives, takes, giver = best
        if not gives and len(takes) == 1 and giver != taker:
            takes *= min(gap // takes[0], dict(giver)[takes[0]])
        return gives, takes, giver

    def _exchange(self, taker: Bin, gives: tuple[int, ...], takes: tuple[int, ...], giver: Bin) -> tuple[Bin, ...]:
        """Makes the exchange as often as both bins stand. Returns the bins that it touched."""
        times = self.under[taker] // 2 if taker == giver else min(self.under[taker], self.under[giver])
        self.exchanges += times
        for old in (taker, giver):
            self.under[old] -= times
        for old in {taker, giver}:
            if not self.under[old]:
                del self.under[old]
                self.donors.drop(old)
        new = _exchanged(taker, gives, takes), _exchanged(giver, takes, gives)
        for b in new:
            if not b:
                self.spare -= times * self.capacity
            elif fill(b) == self.capacity:
                self.full[b] += times
            else:
                self.under[b] += times
        return taker, giver, *new


def swap_search(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """The bins that the search ends with."""
    return SwapSearch(bins, capacity).run()


class Plan:
    """Where the k-th piece of each length goes. Pieces are numbered by length, then in any fixed order."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        search = SwapSearch(Counter({((length, 1),): n for length, n in counts.items()}), capacity)
        bins = search.run()
        self.exchanges = search.exchanges
        before, total = {}, 0
        for length in sorted(counts):
            before[length], total = total, total + counts[length]
        first, sequence, offset, base = [], [], [], 0
        for held, n in sorted(bins.items(), reverse=True):
            at = 0
            for length, times in held:
                for _ in range(times):
                    first.append(before[length])
                    sequence.append(base)
                    offset.append(at)
                    before[length] += n
                    at += length
            base += n
        order = np.argsort(np.array(first, np.int64), kind="stable")
        self.first, self.sequence, self.offset = (np.array(x, np.int64)[order] for x in (first, sequence, offset))
        self.sequences = base

    def find(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, place, "right") - 1
        return self.sequence[at] + place - self.first[at], self.offset[at]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each document's ids and the end id, cut every capacity tokens: (id, piece, start, length, crc and, with_ids, ids)."""
    kinds, arrow = schema_of("id long, piece int, start long, length long, crc long" + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keep_blanks=False)
        for batch in batches:
            for row, data, bounds in W.slices(batch.column(1), SLICE_BYTES):
                ids, at = encode.ids(data, bounds)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                size = np.diff(at)
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                piece = W.ranges(np.zeros(len(many), np.int64), many)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw, lo = memoryview(ids.tobytes()), 4 * (at[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(doc + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    ends = np.r_[0, np.cumsum(length)].astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))).cast(arrow.types[5]))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), kinds)


def pack(
    docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, with_ids: bool = True,
) -> DataFrame:
    """Packs the documents' tokens into sequences of at most capacity tokens.

    A document is its text's ids by the vocabulary file at path (word_bpe_49k by default), without special tokens,
    then end_id. Only documents over capacity are cut, into pieces of capacity tokens and a last one that may be
    shorter.

    Returns one row per piece: the id column, piece (from 0), start (ids of its document before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), sequence_id (from 0), offset (its place in the
    sequence; a sequence has no gaps) and, with_ids, ids.

    Null text counts as empty: one piece, the end id. Null and repeated ids are packed like others. Other columns are
    neither read nor kept. An empty table gives an empty table.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, path or vocabulary("word_bpe_49k.json"), capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    order = ("length", "id", "piece", "start", "crc")
    placed = with_places(pieces, order)
    kinds, arrow = schema_of(f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.find(batch.column("place").to_numpy())
            cols = [*batch.columns[:5], pa.array(sequence), pa.array(offset), *([batch.column("ids").cast(arrow.types[7])] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return placed.select("id", "piece", "start", "length", "crc", "place", *(["ids"] if with_ids else [])).mapInArrow(run, kinds)

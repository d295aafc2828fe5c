"""Removal of word windows that an earlier document holds, by recompression in Spark rounds.

Every chunk of documents names runs and pairs round by round (see recompression). Spark counts the names:

1. Low symbols: chunks send their distinct names of the first levels, and learn which of them other documents have. A
   window with an inner symbol that no second document has is settled: it stays.
2. High symbols: levels go on as long as shared symbols merge. Symbols of as many words as a window or more, of which
   every part is shared, are sent with their smallest document. Where an earlier document has one, all windows within
   it are settled: a long repeat goes at once, however long.
3. Windows at the edges of long repeats, and in short ones: what is left is sent under the name that the window's own
   symbols of all levels give, with the smallest document.
4. Each chunk drops the words under windows that an earlier document has.

The documents are shuffled by chunk once, and the four steps read that exchange. Chunks hold a fixed number of bytes,
so a task's share does not grow with the table. Names go out as packed arrays, once a chunk however often they occur
there, so a passage that a third of all documents share is no larger than another. What a chunk has found out comes
back to it beside the answers, so that no step repeats an earlier one's look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recompression as R
from . import words as W
from .shared import partitions

LAST = np.iinfo(np.int64).max
_U = np.uint64
#: Levels whose names go out in the first Spark round, and levels that a window of few words can have at all.
LOW_LEVELS, WINDOW_LEVELS = 2, 4
#: UTF-8 bytes of a chunk's documents.
CHUNK_BYTES = 8 << 20
#: Kinds of rows: what the low levels, the high levels and the windows ask, and what a chunk keeps for its next step.
LOW, HIGH, WINDOWS, KEPT = range(4)


def named_windows(words: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name of the innermost symbols, name) of each window; equal windows have equal names, wherever they stand."""
    at, h = words.windows(window), words.hashes()
    core, name = R.sequence_names(h, R.levels_of(h, words.text_of(), WINDOW_LEVELS) if len(at) else [], at, window)
    return at, core, name


class _Chunk:
    """The documents of one chunk in order of their ids, in slices of bounded size."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("id").combine_chunks().fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order))
        self.ids, self.given, self.texts = ids[order], table.column("id").combine_chunks(), table.column("text").combine_chunks()

    def slices(self) -> Iterator[tuple[W.Words, np.ndarray, int]]:
        """Words, the id of each text, and the words before."""
        before = 0
        for row, data, bounds in W.slices(self.texts):
            words = W.split_words(data, bounds)
            yield words, self.ids[row : row + words.texts], before
            before += len(words.starts)


def _concat(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def low_names(chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(distinct names of the low levels in order, whether each stands here more than once)."""
    parts = []
    for words, _, _ in chunk.slices():
        for k, level in enumerate(R.levels_of(words.hashes(), words.text_of(), LOW_LEVELS)):
            parts.append(level.names if k == 0 else level.names[level.made])
    names = np.sort(_concat(parts, _U))
    fresh = np.ones(len(names), bool)
    fresh[1:] = names[1:] != names[:-1]
    at = np.flatnonzero(fresh)
    return names[at], np.diff(np.r_[at, len(names)]) > 1


class _Marks:
    """Which names are shared, as marked places of their buckets; a name may meet another's mark, which only leaves more to the later steps."""

    def __init__(self, back: pa.Table, buckets: int) -> None:
        self.buckets = buckets
        self.begin, self.size, bits, total = np.zeros(buckets, np.int64), np.ones(buckets, np.int64), [], 1
        for r in back.to_pylist():
            if r["kind"] == LOW:
                own = np.unpackbits(np.frombuffer(r["flags"], np.uint8)).astype(bool)
                self.begin[r["bucket"]], self.size[r["bucket"]] = total, len(own)
                bits.append(own)
                total += len(own)
        self.bits = np.concatenate([np.zeros(1, bool), *bits])

    def has(self, names: np.ndarray) -> np.ndarray:
        bucket = _bucket(names, self.buckets).astype(np.int64)
        return self.bits[self.begin[bucket] + _mark(names, self.size[bucket])]


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a name, by its high bits."""
    return ((names >> _U(32)) * _U(buckets)) >> _U(32)


def _mark(names: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The place of a name among size marks, by its low bits."""
    return (((names & _U(0xFFFFFFFF)) * np.asarray(size, _U)) >> _U(32)).astype(np.int64)


def high_symbols(chunk: _Chunk, marks: _Marks, window: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which windows may be shared, the number of words, and (name, first word, words, document) of every symbol of a window's words or more whose parts are all shared."""
    alive, total, names, starts, sizes, docs = [], 0, [], [], [], []
    for words, ids, before in chunk.slices():
        total = before + len(words.starts)
        h, text = words.hashes(), words.text_of()
        at = words.windows(window)
        low, high, there, open_ = at, at + window - 1, np.ones(len(at), bool), np.ones(len(at), bool)
        begin, good, k = np.arange(len(h) + 1), np.ones(len(h), bool), 0
        while (good[1:] & good[:-1] & (text[1:] == text[:-1])).any():  # shared symbols side by side merge sooner or later
            k += 1
            level = R.rise(h, text, k)
            good, begin = ~R.any_in(~good, level.first[:-1], level.first[1:]), begin[level.first]
            if k <= LOW_LEVELS:
                good &= marks.has(level.names) if k == 1 else ~level.made | marks.has(level.names)
                lo, hi, inner = R.inside(level, low, high)
                there &= inner
                low, high = np.where(there, lo, 0), np.where(there, hi, 0)
                open_ &= ~there | ~R.any_in(~good, low, high + 1)
            size = np.diff(begin)
            long = np.flatnonzero(good & level.made & (size >= window))
            names.append(level.names[long])
            starts.append(begin[long] + before)
            sizes.append(size[long])
            docs.append(ids[level.text[long]])
            h, text = level.names, level.text
        alive.append(open_)
    return _concat(alive, bool), total, _concat(names, _U), _concat(starts, np.int64), _concat(sizes, np.int64), _concat(docs, np.int64)


def open_windows(chunk: _Chunk, alive: np.ndarray, covered: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a window is alive and starts at no covered word, whether at one, and name and document of the former)."""
    open_, gone, names, docs, begin = [], [], [], [], 0
    for words, ids, before in chunk.slices():
        at = words.windows(window)
        gone.append(covered[at + before])
        open_.append(alive[begin : begin + len(at)] & ~gone[-1])
        begin += len(at)
        at = at[open_[-1]]
        if len(at):
            h, text = words.hashes(), words.text_of()
            names.append(R.sequence_names(h, R.levels_of(h, text, WINDOW_LEVELS), at, window)[1])
            docs.append(ids[text[at]])
    return _concat(open_, bool), _concat(gone, bool), _concat(names, _U), _concat(docs, np.int64)


class _Asked:
    """Distinct names that a chunk sends: the place of each occurrence's name, and whether a smaller document here has it."""

    def __init__(self, names: np.ndarray, docs: np.ndarray) -> None:
        self.names, self.place = np.unique(names, return_inverse=True)
        self.least = np.full(len(self.names), LAST)
        np.minimum.at(self.least, self.place, docs)
        self.earlier = self.least[self.place] < docs

    def rows(self, kind: int, chunk: int, buckets: int) -> Iterator[tuple]:
        """Within a bucket names go by their smallest document."""
        for b, lo, hi in _deal(self.names, buckets):
            order = np.lexsort((self.names[lo:hi], self.least[lo:hi]))
            who, times = np.unique(self.least[lo:hi], return_counts=True)
            yield kind, chunk, b, self.names[lo:hi][order].tobytes(), who.tobytes(), times.astype(np.int32).tobytes()


def _deal(names: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Sorted names to buckets: (bucket, first, last exclusive) of the buckets that have any."""
    there, begin = np.unique(_bucket(names, buckets), return_index=True)
    return zip(there.astype(np.int64).tolist(), begin.tolist(), [*begin[1:].tolist(), len(names)][: len(begin)], strict=True)


_SENT = "kind int, chunk long, bucket long, names binary, docs binary, times binary"
_BACK = "kind int, chunk long, bucket long, flags binary, places binary, spans binary"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in ddl.split(", ")])


def _as_table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _arrow(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _keep(chunk: int, *arrays: np.ndarray) -> tuple:
    """A row that comes back to the chunk as it is; it has a bucket of its own."""
    return KEPT, chunk, -1 - chunk, *(x.tobytes() for x in arrays)


def _kept(back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept row's bits, places and spans."""
    r = next(r for r in back.to_pylist() if r["kind"] == KEPT)
    return np.unpackbits(np.frombuffer(r["flags"], np.uint8)).astype(bool), np.frombuffer(r["places"], np.int32), np.frombuffer(r["spans"], np.int64)


def _flags(back: pa.Table) -> np.ndarray:
    """The answers to a chunk's names, in the order of the names."""
    got = sorted((r["bucket"], r["flags"], int(np.frombuffer(r["places"], np.int64)[0])) for r in back.to_pylist() if r["kind"] != KEPT)
    return np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(flags, np.uint8), count=n) for _, flags, n in got]]).astype(bool)


def _answer(table: pa.Table) -> pa.Table:
    """For one bucket: whether each chunk's names are shared (LOW, as marks), or in an earlier document (HIGH, WINDOWS)."""
    rows = table.to_pylist()
    kind = rows[0]["kind"]
    if kind == KEPT:
        return _as_table([(KEPT, r["chunk"], r["bucket"], r["names"], r["docs"], r["times"]) for r in rows], _BACK)
    names = [np.frombuffer(r["names"], np.uint32 if kind == LOW else _U) for r in rows]
    distinct, place = np.unique(np.concatenate(names), return_inverse=True)
    if kind == LOW:
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["docs"], np.uint8), count=len(x)) for r, x in zip(rows, names, strict=True)])
        flag = np.bincount(place, 1 + twice)[place] > 1
    else:
        docs = np.concatenate([np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["times"], np.int32)) for r in rows])
        least = np.full(len(distinct), LAST)
        np.minimum.at(least, place, docs)
        flag = least[place] < docs
    out, begin = [], 0
    for r, own in zip(rows, names, strict=True):
        mine = flag[begin : begin + len(own)]
        begin += len(own)
        if kind == LOW:
            bits = np.zeros(8 * len(own), bool)
            bits[_mark(own[mine], len(bits))] = True
        else:
            bits = mine[np.argsort(own)]
        out.append((kind, r["chunk"], r["bucket"], np.packbits(bits).tobytes(), np.int64(len(own)).tobytes(), b""))
    return _as_table(out, _BACK)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Drops each word covered by a window of that many words that also starts in a document with a smaller id.

    Words are runs of characters other than blanks (space, tab, line breaks), kept as they are. Windows are judged on
    the input, all at once, so the result does not depend on any order of removal. Chunks hold chunk_bytes of text, or
    less; a document is not cut, so a longer one is more.

    Returns one row per input row: the id column, n_words, n_removed, removed (array of [first, last) word spans that
    go) and kept_text (the words left, joined by one space).

    Null or empty text, or one of fewer words than a window: nothing goes. Rows with equal ids do not take words from
    each other. A null id counts as larger than any other. Other columns are neither read nor kept, so their names
    are free. An empty table gives an empty table.
    """
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(n, -(-total // chunk_bytes))
    buckets = -(-chunks // 2)
    # Rows that equal each other are dealt by the input's partition too, so that they don't all meet.
    base = base.withColumn("chunk", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)))
    if buckets > n:
        base = base.repartition(buckets, "chunk")
    by_chunk = base.groupBy("chunk")

    def send_low(key: tuple, table: pa.Table) -> pa.Table:
        # Their low halves do: a mix-up in a bucket, like one of marks, only leaves more to the later steps.
        names, twice = low_names(_Chunk(table))
        return _as_table([(LOW, key[0].as_py(), b, names[lo:hi].astype(np.uint32).tobytes(), np.packbits(twice[lo:hi]).tobytes(), b"") for b, lo, hi in _deal(names, buckets)], _SENT)

    def send_high(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _as_table([], _SENT)
        alive, total_words, names, starts, sizes, symbol_docs = high_symbols(_Chunk(table), _Marks(back, buckets), window)
        asked = _Asked(names, symbol_docs)
        here = asked.earlier  # an earlier document of this chunk has it
        spans = np.concatenate([[total_words, here.sum()], starts[here], sizes[here], starts[~here], sizes[~here]]).astype(np.int64)
        return _as_table([*asked.rows(HIGH, key[0].as_py(), buckets), _keep(key[0].as_py(), np.packbits(alive), asked.place[~here].astype(np.int32), spans)], _SENT)

    def send_windows(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _as_table([], _SENT)
        alive, place, spans = _kept(back)
        total_words, known, spans = int(spans[0]), int(spans[1]), spans[2:]
        starts, sizes = np.concatenate([spans[:known], spans[2 * known :][: len(place)]]), np.concatenate([spans[known : 2 * known], spans[2 * known + len(place) :]])
        held = np.r_[np.ones(known, bool), _flags(back)[place]]
        open_, gone, names, window_docs = open_windows(_Chunk(table), alive, W.cover(total_words, starts[held], sizes[held] - window + 1), window)
        asked = _Asked(names, window_docs)
        at = np.flatnonzero(open_)
        gone[at[asked.earlier]], open_[at[asked.earlier]] = True, False
        bits = np.packbits(np.concatenate([open_, gone]))
        return _as_table([*asked.rows(WINDOWS, key[0].as_py(), buckets), _keep(key[0].as_py(), bits, asked.place[~asked.earlier].astype(np.int32), np.array([len(open_)]))], _SENT)

    def finish(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([], [], [], [], [])
        bits, place, spans = _kept(back)
        open_, gone = bits[: spans[0]], bits[spans[0] : 2 * spans[0]]
        gone[open_] = _flags(back)[place]
        return _without(_Chunk(table), gone, window)

    back = by_chunk.applyInArrow(send_low, _SENT)
    for step in (send_high, send_windows):
        back = by_chunk.cogroup(_answered(back, buckets, n).groupBy("chunk")).applyInArrow(step, _SENT)
    done = by_chunk.cogroup(_answered(back, buckets, n).groupBy("chunk")).applyInArrow(finish, "id long, n_words long, n_removed long, removed array<array<long>>, kept_text string")
    return done.withColumnRenamed("id", id_col)


def _answered(sent: DataFrame, buckets: int, n: int) -> DataFrame:
    return (sent.repartition(buckets, "bucket") if buckets > n else sent).groupBy("bucket").applyInArrow(_answer, _BACK)


def _without(chunk: _Chunk, gone: np.ndarray, window: int) -> pa.Table:
    """The documents of a chunk less the words under windows that are gone."""
    counts, removed, spans, texts, begin = [], [], [], [], 0
    for words, _, _ in chunk.slices():
        at = words.windows(window)
        drop = W.cover(len(words.starts), at[gone[begin : begin + len(at)]], window)
        begin += len(at)
        for i in range(words.texts):
            lo, hi = words.first[i], words.first[i + 1]
            mine = drop[lo:hi]
            raw = words.data[words.bounds[i] : words.bounds[i + 1]].tobytes()
            edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            counts.append(hi - lo)
            removed.append(int(mine.sum()))
            spans.append(edges.reshape(-1, 2).tolist())
            left = np.flatnonzero(~mine) + lo
            off = words.bounds[i]
            texts.append(b" ".join([raw[s:e] for s, e in zip((words.starts[left] - off).tolist(), (words.ends[left] - off).tolist(), strict=True)]))
    return _result(chunk.given, counts, removed, spans, texts)


def _result(ids, counts, removed, spans, texts) -> pa.Table:
    return pa.table({
        "id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "removed": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
    })

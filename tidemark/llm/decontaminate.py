"""Benchmark passages in training texts, found with an FM-index of each training shard.

A shard is an Arrow batch of documents. Its words become numbers in the benchmark's vocabulary; other words can be in
no match, so they only end runs. The shard's FM-index holds the runs that are long enough. All test phrases are
searched backwards at once, their occurrences located by sampled suffix positions, and the spans merged.

The benchmark goes to the tasks in blocks of bounded size, as files in the shared folder. A task reads its documents once,
and searches a batch of them for one block after another. Most benchmarks are one block, which a worker keeps.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import outputs
from . import words as W
from .batches import beside, rejoined, schema_of, tidy
from .fm_index import FmIndex, index_runs
from .places import with_places
from .shared import cut, new_dir


class Phrases:
    """Windows of the items of a block: numbers of their words, and the items that have each."""

    def __init__(self, items: list[str], texts: list[str], window: int) -> None:
        data, bounds = W.buffers(pa.array(texts, pa.large_string()))
        words = W.split_words(data, bounds, W.ALPHANUMERIC)
        h = words.hashes(lower=True)
        self.items = items
        self.vocabulary, number = np.unique(h, return_inverse=True)
        self.might = np.zeros(1 << 20, bool)
        self.might[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        number = number + 1
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        text = words.text_of()
        at = words.windows(window)
        if len(at):
            by_size[window] = [(number[at[:, None] + np.arange(window)], text[at])]
        for i in np.flatnonzero((words.counts > 0) & (words.counts < window)):
            n = int(words.counts[i])
            by_size.setdefault(n, []).append((number[words.first[i] : words.first[i + 1]][None, :], np.array([i])))
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # patterns, bounds into owners, owners
        for n in sorted(by_size):
            patterns, owners = np.concatenate([x[0] for x in by_size[n]]), np.concatenate([x[1] for x in by_size[n]])
            patterns, place = np.unique(patterns, axis=0, return_inverse=True)
            order = np.argsort(place.ravel(), kind="stable")
            bounds = np.r_[0, np.cumsum(np.bincount(place.ravel(), minlength=len(patterns)))]
            self.windows.append((patterns, bounds, owners[order]))
        self.least = min(by_size, default=0)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.might[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        found = self.vocabulary[at] == h[maybe]
        out[maybe[found]] = at[found] + 1
        return out


def _search(phrases: Phrases, symbols: np.ndarray, place: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length) of each occurrence, and (document, item) of each item that occurs there; limit: the words up to each document's end.

    A document's occurrences of one pattern count once before the pattern's items are looked up.
    """
    index = FmIndex(symbols)
    at, size, owner_doc, owner = [], [], [], []
    for patterns, bounds, owners in phrases.windows:
        low, high = index.search(patterns)
        hits = high - low
        start = place[index.locate(W.ranges(low, hits))]
        at.append(start)
        size.append(np.full(len(start), patterns.shape[1]))
        doc, which = np.divmod(np.unique(np.searchsorted(limit, start, "right") * len(patterns) + np.repeat(np.arange(len(patterns)), hits)), len(patterns))
        many = np.diff(bounds)[which]
        owner_doc.append(np.repeat(doc, many))
        owner.append(owners[W.ranges(bounds[which], many)])
    at, size, owner_doc, owner = map(np.concatenate, (at, size, owner_doc, owner))
    return np.searchsorted(limit, at, "right"), at, size, owner_doc, owner


def _pieces_of_items(items: DataFrame, window: int, most_bytes: int) -> DataFrame:
    """item and text, with texts over most_bytes in pieces that share window - 1 words, so that each window stands whole in one."""
    kinds, arrow = schema_of("item string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                cuts = [(0, len(data))]
                if len(data) > most_bytes:
                    words = W.split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), W.ALPHANUMERIC)
                    n, i, cuts = len(words.starts), 0, []
                    while i < n:
                        j = min(n, max(i + window, int(np.searchsorted(words.ends, words.starts[i] + most_bytes, "right"))))
                        cuts.append((int(words.starts[i]), int(words.ends[j - 1])))
                        i = n if j == n else j - window + 1
                for lo, hi in cuts:
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([data[lo:hi].decode()], pa.string())], schema=arrow)

    return items.mapInArrow(run, kinds)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int, window: int = 10) -> Iterator[list[tuple[str, str]]]:
    """The distinct rows of the benchmark, long ones in pieces, in blocks of at most that many bytes; only a single piece of window words can be larger."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    items = _pieces_of_items(items, window, most_bytes // 2)
    items = cut(items.withColumn("size", (F.octet_length("text") + F.octet_length("item") + 64).cast("long")), "benchmark")
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if total <= most_bytes:
        yield [(r["item"], r["text"]) for r in items.collect()]
        return
    # Rows that lie within one stretch of most_bytes share a block; one that runs over its end is a block of its own.
    first, last = F.expr(f"before div {int(most_bytes)}"), F.expr(f"(before + size - 1) div {int(most_bytes)}")
    placed = cut(with_places(items, ("item", "text"), "size").select("item", "text", first.alias("stretch"), (first != last).alias("alone")), "blocks")
    for key in placed.select("stretch", "alone").distinct().orderBy("stretch", "alone").collect():  # two rows for most_bytes at most
        block = placed.where((F.col("stretch") == key["stretch"]) & (F.col("alone") == key["alone"]))
        yield [(r["item"], r["text"]) for r in block.collect()]


def _stored(docs: DataFrame, blocks: Iterator[list[tuple[str, str]]], window: int) -> list[str]:
    """Files of the blocks' phrases, without those that have none. The driver holds one block at a time."""
    folder, files = new_dir(docs.sparkSession, "phrases"), []
    outputs.make(folder)
    for k, block in enumerate(blocks):
        phrases = Phrases([x[0] for x in block], [x[1] for x in block], window)
        if phrases.least:
            files.append(outputs.fresh(folder, k, ".pickle"))
            with outputs.writer(files[-1]) as f:
                pickle.dump(phrases, f)
    return files


@lru_cache(maxsize=1)
def _load(file: str) -> Phrases:
    """The last block used stays in the worker."""
    with outputs.reader(file) as f:
        return pickle.loads(f.read())


#: Bytes of text that are searched at once; a longer text alone.
PART_BYTES = 32 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for row, _, bounds in W.slices(batch.column(1), PART_BYTES):
        yield batch.slice(row, len(bounds) - 1)


class _Batch:
    """The words of a batch's documents, by their fingerprints, and what has been found in them."""

    def __init__(self, texts: pa.Array) -> None:
        self.parts, counts, base = [], [], 0
        for _, data, bounds in W.slices(texts):
            words = W.split_words(data, bounds, W.ALPHANUMERIC)
            begins = np.zeros(len(words.starts), bool)
            begins[words.first[:-1][words.counts > 0]] = True
            self.parts.append((words.hashes(lower=True), begins, base))
            counts.append(words.counts)
            base += len(words.starts)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.spans: list[list[int]] = [[] for _ in range(len(texts))]
        self.items: list[list[str]] = [[] for _ in range(len(texts))]

    def search(self, p: Phrases) -> None:
        found = [(s, at + base) for h, begins, base in self.parts for s, at in [index_runs(p.numbers(h), begins, p.least)]]
        symbols = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in found)])
        if not len(symbols):
            return
        limit = np.cumsum(self.count)
        doc, at, size, owner_doc, owner = _search(p, symbols, np.concatenate([x for _, x in found]), limit)
        for d, s, e in zip(doc.tolist(), (at - (limit - self.count)[doc]).tolist(), size.tolist(), strict=True):
            self.spans[d] += [s, s + e]
        for pair in np.unique(owner_doc * np.int64(len(p.items)) + owner).tolist():
            self.items[pair // len(p.items)].append(p.items[pair % len(p.items)])
        for d in np.unique(doc).tolist():
            self.spans[d], self.items[d] = _merged(self.spans[d]), sorted(set(self.items[d]))


def _merged(flat: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _without(text: str | None, flat: list[int]) -> str | None:
    """The text less its words in the spans and what stands between them."""
    if not flat or text is None:
        return text
    data = text.encode()
    words = W.split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), W.ALPHANUMERIC)
    out, done = [], 0
    for s, e in zip(flat[::2], flat[1::2], strict=True):
        out.append(data[done : words.starts[s]])
        done = words.ends[e - 1]
    return b"".join([*out, data[done:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, with_text: bool = False, most_block_bytes: int = 4 << 20,
) -> DataFrame:
    """Words of documents that stand in an occurrence of a benchmark window.

    Both sides are lower-cased (A-Z); words are runs of 0-9, a-z and characters beyond ASCII. A window is that many
    consecutive words of an item; an item of fewer words, but not none, is one window.

    Returns one row per input row: the id column, n_words, n_hit (words inside any occurrence), n_items and items
    (items with an occurring window, as sorted strings), items_sha256 (of them, comma-joined), contaminated, spans
    ([first, last) word numbers, merged) and, with_text, clean_text (the text without those spans).

    Null or empty text: no words, not contaminated; clean_text stays as it was. An item without words or text matches
    nothing, one with a null id counts as ''. Repeated items count once in items. Repeated or null document ids: each
    row is judged on its own. Other columns are neither read nor kept. Empty tables: no hits, or no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return _all_blocks(base, benchmark, item_col, item_text_col, window, with_text, most_block_bytes)


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most_block_bytes: int = 4 << 20) -> DataFrame:
    """The rows and columns of docs, their texts without the spans that decontaminate finds; n_chars, if there, follows the text.

    Every row is judged by its own text, whatever its id, and stays; null texts stay null. Columns may have any names.
    An empty table gives an empty table, an empty benchmark the rows as they are.
    """
    made = _all_blocks(beside(docs, text_col), benchmark, item_col, item_text_col, window, True, most_block_bytes)
    return rejoined(docs, text_col, made, "clean_text")


def _all_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, with_text: bool, most_block_bytes: int) -> DataFrame:
    """docs: any column, and text."""
    files = _stored(docs, _blocks(benchmark, item_col, item_text_col, most_block_bytes, window), window)
    ddl = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<array<long>>"
    kinds = T.StructType([docs.schema.fields[0], *schema_of(ddl + (", clean_text string" if with_text else ""))[0].fields])
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            held = _Batch(batch.column(1))
            for file in files:
                held.search(_load(file))
            spans, items = held.spans, held.items
            hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            cols = [batch.column(0), held.count, hit, list(map(len, items)), items, sha, [h > 0 for h in hit], [[x[k : k + 2] for k in range(0, len(x), 2)] for x in spans]]
            if with_text:
                cols.append([_without(t, s) for t, s in zip(batch.column(1).to_pylist(), spans, strict=True)])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return docs.mapInArrow(tidy(run), kinds)

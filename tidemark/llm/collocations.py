"""Phrases whose words stand together more often than their parts would, per language."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import count_nets as N
from . import words as W
from .batches import schema_of, tidy
from .places import with_group_places
from .shared import cut, lookup, partitions, small_batches

#: Bytes of text that a task counts before it writes a net, and phrases from one mark of the sample of them to the next.
SHARD_BYTES, MARK = 32 << 20, 16_384

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

#: Bytes of the filter of frequent words and pairs, a bit a slot, which all tasks get; and in how many segments it is made.
FILTER_BYTES, SEGMENTS = 16 << 20, 64

_SLOTS = "segment int, counts binary, lang string, n long"
_KEPT = "segment int, bits binary"
_SHARDS = "lang string, net binary, marks array<array<long>>"
_PIECES = "lang string, range int, net binary"
_COUNTED = "lang string, range int, words array<long>, n long, lefts array<long>, longer long, word string, net binary"
_ASKED = "lang string, range int, words array<long>, longer long"
_FOUND = "lang string, words array<long>, longer long, n long, word string"


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Fingerprints of the words of a run of texts, whether each and the next stand in one piece, and the distinct ones with their bytes."""
    low = _SMALL[data]
    w = W.split_words(low, bounds, _INSIDE)
    h = w.hashes().view(np.int64)
    breaks = np.cumsum(_BREAK[low])[w.starts] if len(h) else np.zeros(0, np.int64)
    text = w.text_of()
    joined = np.r_[(breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1]), False] if len(h) else np.zeros(0, bool)
    named, at = np.unique(h, return_index=True)
    sizes = (w.ends - w.starts)[at]
    body = low[W.ranges(w.starts[at], sizes)]
    return h, joined, named, pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(body)])


def _lang_key(lang: str) -> np.int64:
    return np.int64(W.span_hash(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1])).view(np.int64)[0])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bytes, bounds) of runs of rows of lang and text."""
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            for _, data, bounds in W.slices(batch.column(1).filter(pc.equal(batch.column(0), lang))):
                yield lang, data, bounds


def _slot_counts(docs: DataFrame, filter_bytes: int) -> DataFrame:
    """Counts of words and pairs by slot, in segments of slots, for each SHARD_BYTES of a task's texts; and of all words by language."""
    kinds, arrow = schema_of(_SLOTS)
    n = 8 * filter_bytes
    cuts = np.arange(SEGMENTS + 1) * n // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, size = [], defaultdict(int), 0

        def flush() -> Iterator[pa.RecordBatch]:
            at, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint32)]), return_counts=True)
            ends = np.searchsorted(at, cuts)
            some = [k for k in range(SEGMENTS) if ends[k] < ends[k + 1]]
            blobs = [N.pack_counts(at[ends[k] : ends[k + 1]] - cuts[k], counts[ends[k] : ends[k + 1]]) for k in some]
            columns = [some + [None] * len(total), blobs + [None] * len(total), [None] * len(some) + list(total), [None] * len(some) + list(total.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
            found.clear()
            total.clear()

        for lang, data, bounds in _runs(batches):
            h, joined, *_ = _tokens(data, bounds)
            keys = h ^ _lang_key(lang)
            found += [N.slots(k, n).astype(np.uint32) for k in (keys, N.pair_keys(keys)[joined[:-1]])]
            total[lang] += len(h)
            size += len(data)
            if size >= SHARD_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(tidy(run), kinds)


def _frequent_slots(counts: DataFrame, least: int, filter_bytes: int) -> N.Filter:
    """The filter of slots of at least that count: each segment is made where its counts are summed, so the driver gets filter_bytes in all."""
    _, arrow = schema_of(_KEPT)
    cuts = np.arange(SEGMENTS + 1) * (8 * filter_bytes) // SEGMENTS

    def run(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        total = np.zeros(cuts[segment + 1] - cuts[segment], np.int64)
        for blob in table.column("counts"):
            N.add_counts(blob.as_py(), total)
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((segment, np.packbits(total >= least).tobytes()), arrow.types, strict=True)], schema=arrow)

    made = {r["segment"]: bytes(r["bits"]) for r in counts.where("segment IS NOT NULL").groupBy("segment").applyInArrow(run, _KEPT).collect()}
    return N.Filter(b"".join(made.get(k, bytes((cuts[k + 1] - cuts[k]) // 8)) for k in range(SEGMENTS)))


def _shards(docs: DataFrame, most: int, known: Broadcast) -> DataFrame:
    """docs: lang, text. Nets of the counts of each SHARD_BYTES of a task's texts, one a language, with marks at even steps among its phrases.

    known: the filter of frequent words and pairs. Phrases with another word or pair can't be frequent, so they are not counted.
    """
    kinds, arrow = schema_of(_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, joined = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                if len(h):
                    paths = N.of_words(h, joined, (np.concatenate([p[2] for p in parts]), pa.concat_arrays([p[3] for p in parts])), most)
                    (_, net), *_ = N.cut_nets(paths, [])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((lang, net, N.marks(paths, MARK)), arrow.types, strict=True)], schema=arrow)
            held.clear()

        for lang, data, bounds in _runs(batches):
            h, joined, named, texts = _tokens(data, bounds)
            of = known.value.has(named ^ _lang_key(lang))
            kept = of[np.searchsorted(named, h)]
            joined[:-1] &= kept[:-1] & kept[1:] & known.value.has(N.pair_keys(h ^ _lang_key(lang)))
            held[lang].append((h[kept], joined[kept], named[of], texts.filter(pa.array(of))))
            size += len(data)
            if size >= SHARD_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(tidy(run), kinds)


def _splitters(shards: DataFrame) -> list[tuple]:
    """At most one for each shuffle partition: (lang, word, ...) from which ranges of about equally many of the shards' phrases start."""
    n = partitions(shards.sparkSession)
    sample = shards.select("lang", F.explode("marks").alias("words")).repartitionByRange(n, "lang", "words")
    first = sample.groupBy(F.spark_partition_id()).agg(F.min(F.struct("lang", "words")).alias("s")).select("s.*")
    return sorted((r["lang"], *r["words"]) for r in first.collect())[1:]


def _pieces(shards: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Each shard's net cut at the splitters."""
    kinds, arrow = schema_of(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, net in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first, end = bisect_right(splitters, (lang,)), bisect_right(splitters, (lang + "\0",))
                cuts = N.cut_nets(N.paths_of(N.read(net.as_py())), [s[1:] for s in splitters[first:end]])
                for k in range(0, len(cuts), 64):
                    some = cuts[k : k + 64]
                    columns = [[lang] * len(some), [first + r for r, _ in some], [b for _, b in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return shards.select("lang", "net").mapInArrow(tidy(run), kinds)


def _counted(pieces: DataFrame, splitters: list[tuple], least: int) -> DataFrame:
    """For each range and language: a row with the net of its phrases of at least that count, and a row for each such phrase of two words or more.

    The phrase's row has the counts of its prefixes (lefts), the largest of a phrase one word longer that starts with it
    (longer) and its first word. A prefix of the range's splitter belongs to an earlier range: its row has no count.
    """
    _, arrow = schema_of(_COUNTED)

    def run(table: pa.Table) -> pa.Table:
        lang, place = table.column("lang")[0].as_py(), table.column("range")[0].as_py()
        total, parts, size = None, [], 0
        for net in table.column("net"):
            parts.append(N.paths_of(N.read(net.as_py())))
            size += parts[-1].size
            if size > max(total.size if total else 0, 1 << 18):  # each union at least doubles what was summed
                total, parts, size = N.union([*([total] if total else []), *parts]), [], 0
        total = N.frequent(N.union([*([total] if total else []), *parts]), least)
        if not len(total.word[0]):
            return arrow.empty_table()
        start = splitters[place - 1][1:] if place and splitters[place - 1][0] == lang else ()
        own = N.bounds(total, [start])[0] if start else [np.zeros(1, np.int64)] * len(total.word)
        rows = {f: [None] for f in ("words", "n", "lefts", "longer", "word")}
        root, lefts = np.arange(len(total.word[0])), np.zeros((len(total.word[0]), 0), np.int64)
        for d in range(len(total.word)):
            node = np.arange(len(total.word[d]))
            if d:
                up = total.parent[d]
                lefts = np.column_stack([lefts[up], total.weight[d - 1][up]])
                root = root[up]
                longer = np.zeros(len(node), np.int64)
                if d + 1 < len(total.word):
                    np.maximum.at(longer, total.parent[d + 1], total.weight[d + 1])
                rows["words"] += total.phrases(d, node).tolist()
                rows["n"] += [w if k >= own[d][0] else None for k, w in enumerate(total.weight[d].tolist())]
                rows["lefts"] += lefts.tolist()
                rows["longer"] += longer.tolist()
                rows["word"] += [b.decode() for b in total.text.take(pa.array(root)).to_pylist()]
        n = len(rows["n"])
        columns = [[lang] * n, [place] * n, *rows.values(), [N.cut_nets(total, [])[0][1], *[None] * (n - 1)]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return pieces.groupBy("lang", "range").applyInArrow(run, _COUNTED)


def _ranged(asked: DataFrame, splitters: list[tuple]) -> DataFrame:
    """lang, words, longer: adds the range that holds the phrase."""
    kinds, arrow = schema_of(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, words, longer = (batch.column(k) for k in range(3))
            place = [bisect_right(splitters, (a, *b)) for a, b in zip(lang.to_pylist(), words.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip((lang, pa.array(place), words, longer), arrow.types, strict=True)], schema=arrow)

    return asked.select("lang", "words", "longer").mapInArrow(run, kinds)


def _looked_up(asked: DataFrame, nets: DataFrame) -> DataFrame:
    """The count of each asked phrase, by composition with its range's net, and the word of single ones."""
    _, arrow = schema_of(_FOUND)

    def run(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if not len(wanted):
            return arrow.empty_table()
        net = N.read(held.column("net")[0].as_py())
        words = wanted.column("words").to_pylist()
        count, text = np.zeros(len(words), np.int64), np.full(len(words), None, object)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            at = at[np.lexsort(np.array([words[k] for k in at]).T[::-1])]
            found, root = N.compose(net, np.array([words[k] for k in at], np.int64))
            count[at] = found
            if size == 1:
                text[at] = [b.decode() for b in net.text.take(pa.array(root)).to_pylist()]
        columns = [wanted.column("lang"), wanted.column("words"), wanted.column("longer"), count, text]
        return pa.Table.from_arrays([pa.chunked_array(c.cast(t)) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return asked.groupBy("lang", "range").cogroup(nets.where("net IS NOT NULL").groupBy("lang", "range")).applyInArrow(run, _FOUND)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """The best phrases of 2 to most_words words in each language.

    A-Z are lower-cased; texts are split at . , ; : ! ? and line ends into pieces, pieces at spaces and tabs into words. A
    phrase's count is that of all its places within pieces. Candidates have a count a of at least least. Cut after k words,
    with l and r the counts of the two parts, a candidate scores floor(1000000 a a / (l r)); the cut of the lowest score
    counts, the first of several. Candidates inside a longer candidate of inside_percent of their count or more go.

    A first pass counts words and pairs by slots, as many as filter_bytes has bits, whatever the input. The slots of at least
    least go to all tasks of the second pass (a multiple of 64 bytes): a phrase with a word or pair in another slot isn't
    frequent; where slots are full more phrases are counted, and results are the same. There tasks count the phrases of
    SHARD_BYTES of text at a time, sort them and build their minimal weighted automaton. The automata are cut into ranges of prefixes, at marks that they hold at even steps, so that
    a frequent first word, or pair, is split too. The automata of a range are united, weights summed; a candidate's first
    parts are on its own path. What follows a candidate's first word is asked once for all candidates, and composed with
    the ranges' automata of frequent phrases; shorter last parts are those of that phrase. Of the phrases that a candidate
    lies in, those one word longer decide, as longer ones are not more frequent. Arithmetic is in decimals of up to 38
    digits: counts below 10 ** 15 are exact.

    Returns lang, rank (from 1, by score and a descending, then the phrase's UTF-8 bytes), phrase (joined by spaces), a, l,
    r, n (all words of the language) and score; the first top of each language.

    A null language is und. A null, empty or blank text has no words. Repeated rows count each time. A language without
    candidates has no rows; an empty table gives an empty one. Words of any length count. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text <> ''")
    with small_batches(spark):
        counts = cut(_slot_counts(base, filter_bytes), "slot-counts")
    with small_batches(spark, 64):
        known = spark.sparkContext.broadcast(_frequent_slots(counts, least, filter_bytes))
    with small_batches(spark):
        shards = cut(_shards(base, most_words, known), "shard-nets")
    splitters = _splitters(shards)
    with small_batches(spark, 2):
        counted = cut(_counted(_pieces(shards, splitters), splitters, least), "range-nets")
    totals = counts.where("segment IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    phrases = counted.where("words IS NOT NULL")
    over = phrases.where("n IS NULL").groupBy("lang", "words").agg(F.max("longer").alias("over"))  # a few a range
    candidates = phrases.where("n IS NOT NULL").select("lang", "words", F.slice("words", 2, 2**30).alias("rest"), F.col("n").alias("a"), "lefts", "longer", "word")
    asked = candidates.groupBy("lang", F.col("rest").alias("words")).agg(F.max("a").alias("longer"))
    with small_batches(spark, 10_000):
        found = cut(_looked_up(_ranged(asked, splitters), counted.select("lang", "range", "net")), "rests")

    # By length, so that a phrase's rest has its own last parts and words already.
    rests = found.where(F.size("words") == 1).select("lang", F.col("words").alias("rest"), F.array("n").alias("rights"), F.array("word").alias("texts"))
    rows = None
    for size in range(2, most_words + 1):
        mine = lookup(candidates.where(F.size("words") == size), rests, ["lang", "rest"])
        mine = mine.withColumn("texts", F.concat(F.array("word"), "texts")).drop("rest", "word")
        after = found.where(F.size("words") == size).select("lang", "words", F.col("longer").alias("after"))
        mine = cut(mine.join(after, ["lang", "words"], "left").join(F.broadcast(over), ["lang", "words"], "left"), "candidates")
        rests = mine.where("after IS NOT NULL").select("lang", F.col("words").alias("rest"), F.concat(F.array("a"), "rights").alias("rights"), "texts")
        inside = F.greatest("longer", F.coalesce("after", F.lit(0)), F.coalesce("over", F.lit(0)))
        kept = mine.where(100 * inside < inside_percent * F.col("a")).select("lang", "a", "lefts", "rights", "texts")
        rows = kept if rows is None else rows.unionByName(kept)
    big = lambda c: c.cast("decimal(15,0)")

    def scored(left: Column, right: Column) -> Column:
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(F.col("a")) * big(F.col("a"))), big(left) * big(right))
        return F.struct(score.alias("score"), left.alias("l"), right.alias("r"))

    scores = F.zip_with("lefts", "rights", scored)
    best = F.array_min(F.transform(scores, lambda s, k: F.struct(s["score"].alias("score"), k.alias("k"), s["l"].alias("l"), s["r"].alias("r"))))
    rows = rows.select("lang", F.array_join("texts", " ").alias("phrase"), "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    rows = rows.withColumns({"down": -F.col("score"), "less": -F.col("a")})
    placed = with_group_places(cut(rows, "scored"), "lang", ("down", "less", "phrase")).where(F.col("place") < top)
    out = lookup(placed, totals, ["lang"])
    return out.select("lang", (F.col("place") + 1).alias("rank"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r")], F.col("total").alias("n"), F.col("score").cast("long"))

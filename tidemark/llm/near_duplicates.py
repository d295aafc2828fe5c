"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and its maximum; both agree between two sets
with a chance equal to their similarity, and one evaluation makes the two. Bands of values lead to candidates, which
are confirmed on the full sets. Documents of equal sets are one node from the start, named by the set, so a large group of
copies costs a row each; ids only come in at the end. In a band's group every node is first compared with the smallest and with one of a handful. Groups that
still fall into several components are compared across those in blocks, of which only the links come out.

A pair just at 0.8 shares none of 50 bands of 5 values with a chance of about 2 in 10**9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .batches import beside, map_beside, rejoined, schema_of, tidy
from .components import components
from .shared import cut

#: Nodes of a band group that are compared with one of them at random, and nodes of a family that are compared in a task.
HANDFUL, BLOCK = 8, 500


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in order, bounds by text); a text of fewer words is one shingle, one of none has none."""
    words = W.split_words(data, bounds)
    h, counts = words.hashes(lower=True), words.counts
    at = words.windows(size)
    few = np.flatnonzero((counts > 0) & (counts < size))
    starts = np.concatenate([at, words.first[few]])
    sizes = np.concatenate([np.full(len(at), size), counts[few]])
    shingle, text = W.window_hash(h, starts, sizes), np.concatenate([words.text_of()[at], few])
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if words.texts < 1 << 16 else np.int64), kind="stable")]
    shingle, text = shingle[order], text[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    return shingle[fresh], np.r_[0, np.cumsum(np.bincount(text[fresh], minlength=words.texts))]


def min_max_bands(sets: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, a row for each set that isn't empty: half of the bands hold minima, half maxima of the same permutations."""
    begins = bounds[:-1][np.diff(bounds) > 0]
    half = (bands + 1) // 2
    factor, shift = (W.series(2, half * rows) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (W.series(3, half * rows) >> np.uint64(32)).astype(np.uint32)
    value = (sets >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(value)
    keys = np.zeros((2, half, len(begins)), np.uint64)
    weight = W.series(4, rows) | np.uint64(1)
    for k in range(half * rows):
        np.multiply(value, factor[k], out=turned)
        np.add(turned, shift[k], out=turned)
        keys[0, k // rows] += np.minimum.reduceat(turned, begins).astype(np.uint64) * weight[k % rows]
        keys[1, k // rows] += np.maximum.reduceat(turned, begins).astype(np.uint64) * weight[k % rows]
    return W.mix(keys.reshape(2 * half, -1)[:bands].T + W.series(5, 2 * half)[:bands])


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of nodes (lo, hi) whose full sets are similar enough. texts: (node, text), which go by shuffles."""
    a, b = texts.select(F.col("node").alias("lo"), F.col("text").alias("a")), texts.select(F.col("node").alias("hi"), F.col("text").alias("b"))
    both = pairs.join(a.hint("merge"), "lo").join(b.hint("merge"), "hi")
    kinds, arrow = schema_of("lo long, hi long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            for row, data, bounds in W.slices(batch.column("a")):
                n = len(bounds) - 1
                a, a_bounds = shingle_sets(data, bounds, size)
                b, b_bounds = shingle_sets(*W.buffers(batch.column("b").slice(row, n)), size)
                shingle = np.concatenate([a, b])
                pair = np.concatenate([np.repeat(np.arange(n), np.diff(a_bounds)), np.repeat(np.arange(n), np.diff(b_bounds))])
                order = np.lexsort((shingle, pair))
                shingle, pair = shingle[order], pair[order]
                same = (shingle[1:] == shingle[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][same], minlength=n)
                joint = np.diff(a_bounds) + np.diff(b_bounds) - common
                good = np.flatnonzero((100 * common >= percent * joint) & (joint > 0)) + row
                yield pa.RecordBatch.from_arrays([pa.array(lo[good], pa.int64()), pa.array(hi[good], pa.int64())], schema=arrow)

    return both.select("lo", "hi", "a", "b").mapInArrow(tidy(run), kinds).distinct()


def _across(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (lo, hi) between labels of which nodes are similar enough. rest: (low, node, own), the least label of an open group and each node's own.

    Labels that open groups hold together are a family. A family is dealt into blocks; a task compares two blocks, so
    a large family is many tasks, and only links come out. A node stands in as many cells as its family has blocks; in
    files those of a large family take about a byte each, by which Spark would broadcast millions, so they are shuffled.
    """
    family = components(rest.where("low < own").select(F.col("low").alias("lo"), F.col("own").alias("hi")).distinct()).select(F.col("node").alias("own"), F.col("label").alias("family"))
    nodes = cut(rest.select("node", "own").distinct().join(family, "own"), "families")
    blocks = nodes.groupBy("family").agg(F.expr(f"cast(count(*) div {BLOCK} + 1 AS int)").alias("blocks"))
    nodes = nodes.join(blocks, "family").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    cells = nodes.select("node", "own", "family", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("node", "own", "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cells = cut(cells, "cells")
    def compare(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        sets, counts = [], []
        for _, data, bounds in W.slices(table.column("text").combine_chunks()):
            flat, at = shingle_sets(data, bounds, size)
            sets.append(flat)
            counts.append(np.diff(at))
        distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
        counts = np.concatenate(counts)
        at = np.r_[0, np.cumsum(counts)]
        labels, times = np.unique(own, return_counts=True)
        main = labels[times.argmax()]
        lo, hi, mark = [], [], np.zeros(len(distinct), np.int64)
        for i in np.flatnonzero(own != main):
            mark[flat[at[i] : at[i + 1]]] = 1
            common = W.run_sums(mark[flat], at)
            mark[flat[at[i] : at[i + 1]]] = 0
            good = np.flatnonzero((100 * common >= percent * (counts + counts[i] - common)) & (own != own[i]) & (counts > 0))
            other = np.unique(own[good])
            lo += np.minimum(other, own[i]).tolist()
            hi += np.maximum(other, own[i]).tolist()
        return pa.table({"lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    held = cells.hint("merge").join(texts, "node").select("family", "low", "high", "own", "text")
    return held.groupBy("family", "low", "high").applyInArrow(compare, "lo long, hi long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 50, rows: int = 5) -> DataFrame:
    """Groups of documents linked by similar shingle sets.

    Texts are lower-cased (A-Z); words are runs of characters other than blanks. A document's set holds its distinct
    shingles of that many words, or its whole sequence if it has fewer words. Two documents are linked where the
    intersection is at least percent hundredths of the union, confirmed on the full sets. Sets of one size with equal
    sums of two 64-bit fingerprints of their shingles count as equal without a further look.

    Returns one row per input row: the id column, n_shingles, component_id (smallest id reachable by links, its own
    included), kept (its id is component_id) and text_hash (Spark's xxhash64 of the text, to tell rows of one id apart).

    Without text or words: an empty set, linked with nothing, kept. A null id: no link, component_id null, kept.
    Repeated ids: rows of equal texts get equal results; rows of one id with unlike texts are judged each by its own
    text, and lie in one group only if the texts are linked. Other columns are neither read nor kept. An empty table gives an empty table.
    """
    return _grouped(docs, id_col, text_col, shingle, percent, bands, rows).drop("chosen")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80, bands: int = 50, rows: int = 5) -> DataFrame:
    """near_duplicates with chosen: kept, and of several texts of that id in the group the one with the smallest hash."""

    def work(data: np.ndarray, bounds: np.ndarray) -> list:
        sets, at = shingle_sets(data, bounds, shingle)
        n = np.diff(at)
        f1, f2 = (W.run_sums(W.mix(sets ^ salt).astype(np.int64), at) for salt in W.series(6, 2))
        keys = min_max_bands(sets, at, bands, rows) if len(sets) else np.zeros((0, bands), np.uint64)
        ends = np.r_[0, np.cumsum(n > 0) * bands].astype(np.int32)
        return [n, f1, f2, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))]

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = docs.select(F.struct("id", F.xxhash64("text").alias("text_hash")).alias("row"), "text")
    signed = map_beside(base, work, "n_shingles long, f1 long, f2 long, bands array<long>").select("row.*", "n_shingles", "f1", "f2", "bands")
    signed = cut(signed, "signatures")
    linkable = signed.where("id IS NOT NULL AND n_shingles > 0")
    first = F.min(F.struct("id", "text_hash")).alias("rep")  # of the rows with that set
    nodes = linkable.groupBy("f1", "f2", "n_shingles").agg(first, F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.xxhash64("f1", "f2", "n_shingles")), "nodes")
    held = nodes.select("node", F.explode("bands").alias("key"))
    groups = held.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most"), F.count("*").alias("size")).where("hub < most")
    groups = cut(groups.select("key", "hub", "size"), "groups")  # so that Spark can split a hot key in the join
    members = cut(held.join(groups, "key"), "members")

    # One text of each node that has a candidate.
    asked = members.select("node").distinct().join(nodes.select("node", "rep.*"), "node")
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(asked, ["id", "text_hash"]).select("node", "text")
    texts = cut(texts.dropDuplicates(["node"]), "texts")

    # Stars: each node with the smallest of its band group, and with the smallest of a random handful of a larger group.
    handfuls = members.where(f"size > {HANDFUL}").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.expr(f"size div {HANDFUL} + 1")))
    nearby = handfuls.join(handfuls.groupBy("key", "part").agg(F.min("node").alias("lo")), ["key", "part"]).select("lo", F.col("node").alias("hi"))
    pairs = cut(members.select(F.col("hub").alias("lo"), F.col("node").alias("hi")).unionByName(nearby).where("lo < hi").distinct(), "pairs")
    links = cut(_confirm(pairs, texts, shingle, percent), "confirmed")
    labels = components(links)

    # What is open: groups that fall into several components, beyond pairs that have been compared.
    now = members.where("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    now = cut(now, "labelled")
    open_ = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "low")
    open_ = cut(open_, "open-groups")
    rest = now.join(open_, "key").select("low", "node", F.col("label").alias("own")).distinct()
    joined = components(cut(_across(cut(rest, "open"), texts, shingle, percent), "confirmed"))

    classes = nodes.select("f1", "f2", "n_shingles", "node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = classes.join(joined.select(F.col("node").alias("label"), F.col("label").alias("wider")), "label", "left")
    classes = cut(classes.select("f1", "f2", "n_shingles", "rep", F.coalesce("wider", "label").alias("label")), "classes")
    least = classes.groupBy("label").agg(F.min("rep").alias("least"))
    classes = cut(classes.join(least, "label").select("f1", "f2", "n_shingles", "least"), "classes")
    alone = signed.where("id IS NULL OR n_shingles = 0").select("id", "n_shingles", "text_hash", F.struct("id", "text_hash").alias("least"))
    out = linkable.join(classes, ["f1", "f2", "n_shingles"]).select("id", "n_shingles", "text_hash", "least").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("least.id"), F.lit(True))
    chosen = kept & F.coalesce(F.col("text_hash") == F.col("least.text_hash"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("least.id").alias("component_id"), kept.alias("kept"), "text_hash", chosen.alias("chosen"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, with all its columns, whatever their names.

    Of rows of equal id and text that one stays of which the other columns, as JSON text, come first in order. Rows of
    one id with unlike texts are judged each by its own text: what nothing else resembles stays; of several in one group
    the one with the smallest hash of its text. All rows without an id stay, and all without words that
    have an id of their own. An empty table gives an empty table.
    """
    base = beside(docs, text_col)
    base = base.select("row", "text", F.col("row").getField(id_col).cast("long").alias("id"), F.xxhash64("text").alias("h"))
    found = _grouped(base, "id", "text", **limits).where("NOT chosen").select(F.col("id").alias("gone"), F.col("text_hash").alias("gone_h")).distinct()
    rest = base.join(found, (F.col("id") == F.col("gone")) & (F.col("h") == F.col("gone_h")), "left_anti")
    again = cut(base.where("id IS NOT NULL").groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice"), F.col("h").alias("twice_h")), "repeated")
    if not again.isEmpty():
        same = (F.col("id") == F.col("twice")) & (F.col("h") == F.col("twice_h"))
        first = rest.join(again, same, "left_semi").groupBy("id", "h").agg(F.min_by(F.struct("row", "text"), F.to_json("row")).alias("x"))
        rest = rest.join(again, same, "left_anti").select("row", "text").unionByName(first.select("x.row", "x.text"))
    return rejoined(docs, text_col, rest, "text", changed=False)

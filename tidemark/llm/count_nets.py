"""Weighted acyclic automata of phrases: arcs are words, each with the count of the phrase that it ends.

Words are 64-bit fingerprints. A set of phrases is held in two forms: Paths, the sorted prefix tree, in which sums and
cuts are made; and a net, the minimal automaton, in which it is written and sent: states with equal right languages,
counts included, are one. All is done on whole arrays, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import words as W


@dataclass
class Paths:
    """The prefix tree of phrases, sorted by (parent, word) at each depth; weight is the phrase's count; text: the words themselves for depth 0."""

    parent: list[np.ndarray]
    word: list[np.ndarray]
    weight: list[np.ndarray]
    text: pa.Array

    @property
    def size(self) -> int:
        return sum(map(len, self.word))

    def children(self, d: int) -> np.ndarray:
        """Where the children of each node of depth d start among depth d + 1, and an end."""
        return np.searchsorted(self.parent[d + 1], np.arange(len(self.word[d]) + 1))

    def phrases(self, d: int, nodes: np.ndarray) -> np.ndarray:
        """The d + 1 words of nodes of depth d, a row each."""
        out = np.empty((len(nodes), d + 1), np.int64)
        for k in range(d, -1, -1):
            out[:, k] = self.word[k][nodes]
            nodes = self.parent[k][nodes]
        return out


def of_words(words: np.ndarray, joined: np.ndarray, texts: tuple[np.ndarray, pa.Array], most: int) -> Paths:
    """Counts of all phrases of up to most words. joined: whether a word and the next stand in one piece. texts: fingerprints and words, at least of all words."""
    u, at, n = np.unique(words, return_inverse=True, return_counts=True)
    named, first = np.unique(texts[0], return_index=True)
    out = Paths([np.zeros(len(u), np.int64)], [u], [n], texts[1].take(pa.array(first[np.searchsorted(named, u)])))
    place, node = np.arange(len(words)), at
    for d in range(1, most):
        on = joined[place + d - 1]
        place, node = place[on], node[on]
        key, node, n = np.unique((node << 32) | at[place + d], return_inverse=True, return_counts=True)
        out.parent.append(key >> 32)
        out.word.append(u[key & 0xFFFFFFFF])
        out.weight.append(n)
    return out


def union(parts: list[Paths]) -> Paths:
    """All phrases of the parts, their counts summed. At least one part; all of one depth."""
    if len(parts) == 1:
        return parts[0]
    depth = len(parts[0].word)
    symbols = np.unique(np.concatenate([w for p in parts for w in p.word]))
    out = Paths([], [], [], parts[0].text)
    moved = [np.zeros(1, np.int64) for _ in parts]
    for d in range(depth):
        keys = np.concatenate([(m[p.parent[d]] << 32) | np.searchsorted(symbols, p.word[d]) for m, p in zip(moved, parts, strict=True)])
        weights = np.concatenate([p.weight[d] for p in parts])
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else np.zeros(0, np.int64)
        key = keys[order[starts]]
        out.parent.append(key >> 32)
        out.word.append(symbols[key & 0xFFFFFFFF])
        out.weight.append(np.add.reduceat(weights[order], starts) if len(starts) else weights)
        new = np.empty(len(keys), np.int64)
        new[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
        if d == 0:
            out.text = pa.concat_arrays([p.text for p in parts]).take(pa.array(order[starts]))
        ends = np.cumsum([len(p.word[d]) for p in parts])
        moved = [new[e - len(p.word[d]) : e] for e, p in zip(ends, parts, strict=True)]
    return out


def frequent(p: Paths, least: int) -> Paths:
    """Phrases of at least that count. Their prefixes are among them, since none is rarer."""
    keep = [w >= least for w in p.weight]
    new = [np.cumsum(k) - 1 for k in keep]
    parent = [p.parent[0][keep[0]]] + [new[d - 1][p.parent[d][keep[d]]] for d in range(1, len(keep))]
    return Paths(parent, [w[k] for w, k in zip(p.word, keep, strict=True)], [w[k] for w, k in zip(p.weight, keep, strict=True)], p.text.filter(pa.array(keep[0])))


def marks(p: Paths, every: int) -> list[list[int]]:
    """Phrases at even steps of the deepest level that has any, one for so many nodes of all levels.

    The steps start at a place that depends on the words, so that the marks of many small trees lie anywhere in them.
    """
    d = max((k for k in range(len(p.word)) if len(p.word[k])), default=0)
    n = len(p.word[d])
    wanted = min(n, max(1, p.size // every))
    start = int(W.mix(np.bitwise_xor.reduce(p.word[d].view(np.uint64), keepdims=True))[0]) / 2**64
    at = ((np.arange(wanted) + start) * n / max(1, wanted)).astype(np.int64)
    return p.phrases(d, np.minimum(at, n - 1)).tolist()


def bounds(p: Paths, splitters: list[tuple[int, ...]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each depth, where the phrases from each splitter on start, and the same with the splitter's own prefix, where p has it.

    Phrases go in order of their words, a prefix before what it leads to.
    """
    depth = len(p.word)
    starts = [p.children(d) for d in range(depth - 1)]
    own, low = np.zeros((depth, len(splitters)), np.int64), np.zeros((depth, len(splitters)), np.int64)
    for k, words in enumerate(splitters):
        first, end, inside = 0, len(p.word[0]), True
        for d in range(depth):
            at = first
            if inside and d < len(words):
                at = first + int(np.searchsorted(p.word[d][first:end], words[d]))
                inside = at < end and p.word[d][at] == words[d]
            else:
                inside = False
            low[d, k] = at
            own[d, k] = at + (inside and d + 1 < len(words))
            if d + 1 < depth:
                first = starts[d][at]
                end = starts[d][at + 1] if inside else first
    return list(own), list(low)


def cut_nets(p: Paths, splitters: list[tuple[int, ...]]) -> list[tuple[int, bytes]]:
    """(range, net) of the ranges between splitters. A range also has the prefixes of the splitter that it starts from, with their counts."""
    depth, n = len(p.word), len(splitters) + 1
    own, low = bounds(p, splitters)
    high = [np.r_[b, len(w)] for b, w in zip(own, p.word, strict=True)]
    low = [np.r_[0, b] for b in low]
    held = [h - lo for h, lo in zip(high, low, strict=True)]
    offset = [np.r_[0, np.cumsum(h)] for h in held]
    parent, word, weight = [], [], []
    for d in range(depth):
        at, of = W.ranges(low[d], held[d]), np.repeat(np.arange(n), held[d])
        word.append(p.word[d][at])
        weight.append(p.weight[d][at])
        parent.append(p.parent[d][at] - low[d - 1][of] + offset[d - 1][of] if d else np.zeros(len(at), np.int64))
        if d == 0:
            text = p.text.take(pa.array(at))
    tree = Paths(parent, word, weight, text)
    arrays = _minimal(tree, offset)
    return [(r, _packed(arrays, r, tree.text, offset[0])) for r in np.flatnonzero(held[0]).tolist()]


def _minimal(p: Paths, offset: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """For each level the arcs by states (first), and the ranges' first states (of); equal states of a range are one."""
    depth, n = len(p.word), len(offset[0]) - 1
    state = np.zeros(len(p.word[-1]), np.int64)
    levels: list[dict[str, np.ndarray]] = []
    for d in reversed(range(depth - 1)):
        starts = p.children(d)
        value = W.mix(p.word[d + 1].view(np.uint64) + W.mix((p.weight[d + 1] + 1).view(np.uint64)) * np.uint64(3)) + W.mix((state + 7).view(np.uint64)) * np.uint64(5)
        sums = np.r_[np.uint64(0), np.cumsum(W.mix(value), dtype=np.uint64)]
        right = sums[starts[1:]] - sums[starts[:-1]]
        of = np.repeat(np.arange(n), np.diff(offset[d]))
        order = np.lexsort((right, of))
        new = np.r_[True, (np.diff(of[order]) != 0) | (right[order][1:] != right[order][:-1])] if len(order) else np.zeros(0, bool)
        kept = order[new]
        arcs = np.diff(starts)[kept]
        at = W.ranges(starts[kept], arcs)
        levels.insert(0, {"word": p.word[d + 1][at], "weight": p.weight[d + 1][at], "goes": state[at], "first": np.r_[0, np.cumsum(arcs)], "of": np.searchsorted(of[kept], np.arange(n + 1))})
        state = np.empty(len(order), np.int64)
        state[order] = np.cumsum(new) - 1
    levels.insert(0, {"word": p.word[0], "weight": p.weight[0], "goes": state, "first": offset[0], "of": np.arange(n + 1)})
    return levels


class Filter:
    """Which of a fixed number of slots have a count of some size. A key's slot counts all keys of the slot, so a slot without it has no frequent key."""

    def __init__(self, bits: bytes) -> None:
        self.held = np.frombuffer(bits, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for every frequent key, and for others that share a slot with one, or with too many others."""
        at = slots(keys, 8 * len(self.held))
        return (self.held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def slots(keys: np.ndarray, n: int) -> np.ndarray:
    return (W.mix(keys.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """A key for each of the keys but the last with the one after it."""
    k = keys.view(np.uint64)
    return W.mix(k[:-1] * np.uint64(0x9E3779B97F4A7C15) + W.mix(k[1:])).view(np.int64)


def pack_counts(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts."""
    arrays = [_narrow(np.diff(at, prepend=0)), _narrow(counts)]
    body = b"".join(a.tobytes() for a in arrays)
    return np.array([len(at), arrays[0].itemsize, arrays[1].itemsize], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def add_counts(blob: bytes, total: np.ndarray) -> None:
    n, a, b = np.frombuffer(blob, np.int64, 3).tolist()
    body = pa.decompress(memoryview(blob)[24:], decompressed_size=n * (a + b), codec="zstd", asbytes=True)
    at = np.cumsum(np.frombuffer(body, _KINDS[a], n), dtype=np.int64)
    total[at] += np.frombuffer(body, _KINDS[b], n, n * a).astype(np.int64)


_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def _narrow(a: np.ndarray) -> np.ndarray:
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(a) or a.max() <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def _packed(levels: list[dict[str, np.ndarray]], r: int, text: pa.Array, starts: np.ndarray) -> bytes:
    """A range's net: words it knows, then for each level counts of arcs by state, labels, counts and targets; then the texts."""
    parts, labels = [], []
    for d, x in enumerate(levels):
        low, high = x["of"][r], x["of"][r + 1]
        begin, end = x["first"][low], x["first"][high]
        labels.append(x["word"][begin:end])
        goes = x["goes"][begin:end] - levels[d + 1]["of"][r] if d + 1 < len(levels) else np.zeros(0, np.int64)
        parts += [np.diff(x["first"][low : high + 1]), x["weight"][begin:end], goes]
    symbols = np.unique(np.concatenate(labels))
    data, at = W.buffers(text.slice(starts[r], starts[r + 1] - starts[r]))
    arrays = [symbols, *[_narrow(np.searchsorted(symbols, x)) for x in labels], *[_narrow(a) for a in parts], _narrow(np.diff(at)), data]
    heads = np.array([len(levels), *[v for a in arrays for v in (a.itemsize, len(a))]], np.int64)
    body = b"".join(a.tobytes() for a in arrays)
    return heads.tobytes() + np.int64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


@dataclass
class Net:
    """An unpacked net: for each level arcs by state, labels as places among symbols."""

    symbols: np.ndarray
    label: list[np.ndarray]
    weight: list[np.ndarray]
    goes: list[np.ndarray]
    first: list[np.ndarray]
    text: pa.Array


def read(blob: bytes) -> Net:
    depth = int(np.frombuffer(blob, np.int64, 1)[0])
    count = 1 + 4 * depth + 2
    heads = np.frombuffer(blob, np.int64, 2 * count, 8).reshape(count, 2)
    begin = 8 * (2 + 2 * count)
    body = pa.decompress(memoryview(blob)[begin:], decompressed_size=int(np.frombuffer(blob, np.int64, 1, begin - 8)[0]), codec="zstd", asbytes=True)
    arrays, at = [], 0
    for item, n in heads.tolist():
        arrays.append(np.frombuffer(body, _KINDS[item], n, at))
        at += item * n
    wide = [a.astype(np.int64) for a in arrays[1 : 1 + 4 * depth]]
    label, rest = wide[:depth], wide[depth:]
    lengths = arrays[-2].astype(np.int64)
    text = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(arrays[-1])])
    return Net(arrays[0], label, rest[1::3], rest[2::3], [np.r_[0, np.cumsum(a)] for a in rest[::3]], text)


def paths_of(net: Net) -> Paths:
    """The sorted prefix tree that a net stands for."""
    node = np.arange(len(net.label[0]))
    out = Paths([np.zeros(len(node), np.int64)], [net.symbols[net.label[0]]], [net.weight[0]], net.text)
    arc = node
    for d in range(1, len(net.label)):
        state = net.goes[d - 1][arc]
        arcs = net.first[d][state + 1] - net.first[d][state]
        arc = W.ranges(net.first[d][state], arcs)
        out.parent.append(np.repeat(np.arange(len(state)), arcs))
        out.word.append(net.symbols[net.label[d][arc]])
        out.weight.append(net.weight[d][arc])
    return out


def compose(net: Net, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of phrases (rows of words) in a net, 0 for what it lacks, and their first words' arcs at the root.

    Rows are walked together, a word at a time: the pairs of a row and a state are the states of the composition.
    """
    state, alive = np.zeros(len(phrases), np.int64), np.ones(len(phrases), bool)
    count, root = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
    for d in range(phrases.shape[1]):
        rank = np.searchsorted(net.symbols, phrases[:, d])
        alive &= net.symbols[np.minimum(rank, len(net.symbols) - 1)] == phrases[:, d]
        arcs = (np.repeat(np.arange(len(net.first[d]) - 1), np.diff(net.first[d])) << 32) | net.label[d]
        if not len(arcs):
            return np.zeros(len(phrases), np.int64), root
        wanted = (state << 32) | rank
        arc = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
        alive &= arcs[arc] == wanted
        count = np.where(alive, net.weight[d][arc], 0)
        if d == 0:
            root = arc
        if d + 1 < phrases.shape[1]:
            state = np.where(alive, net.goes[d][arc], 0)
    return count, root

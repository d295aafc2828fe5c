"""Token ids of whole Arrow batches, with each distinct word encoded once.

A text is cut before blanks that follow other characters, where no token of the public vocabularies goes across; the
pieces repeat, so their ids are looked up by fingerprint and only new ones are encoded. Texts with white space beyond
ASCII, which could join a cut's sides, are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from . import words as W

#: Stands between pieces of a vocabulary that drops blanks; a piece that holds it is encoded alone.
MARK = "\0"
#: Distinct pieces that a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are cut into pieces at once, bytes of new pieces that are encoded as one string, and such strings encoded at once.
SLICE_BYTES, JOINED_BYTES, AT_ONCE = 1 << 20, 4096, 16


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """keep_blanks: pieces hold the blanks before them; else blanks carry no token and are dropped."""

    def __init__(self, path: str, keep_blanks: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keep_blanks = keep_blanks
        self._forget()
        if keep_blanks:  # a byte-level vocabulary: a token has a character for each byte
            vocabulary = self.tokenizer.get_vocab()
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes[i] = len(token)
        else:
            (self.mark,) = self.encode([MARK])[0]

    def _forget(self) -> None:
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the pieces in some order, number of ids of each, all ids). Many pieces are encoded as one string, and its ids dealt out again."""
        fit = [k for k, x in enumerate(pieces) if (x[0] in W.BLANKS and x[-1] not in W.BLANKS if self.keep_blanks else 0 not in x)]
        ends = np.cumsum([len(pieces[k]) for k in fit]) // JOINED_BYTES
        groups = np.split(np.array(fit, np.int64), np.flatnonzero(np.diff(ends)) + 1) if fit else []
        between = b"" if self.keep_blanks else b" \0 "
        order, sizes, flat = [], [], []
        for at in range(0, len(groups), AT_ONCE):
            some = groups[at : at + AT_ONCE]
            for group, ids in zip(some, self.encode([between.join([*(pieces[k] for k in group), b""]).decode() for group in some]), strict=True):
                ids = np.array(ids, np.uint32)
                if self.keep_blanks:
                    last = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(pieces[k]) for k in group])) + 1
                    size = np.diff(np.r_[0, last])
                else:
                    marks = np.flatnonzero(ids == self.mark)
                    size, ids = np.diff(np.r_[-1, marks]) - 1, ids[ids != self.mark]
                if len(size) != len(group) or size.sum() != len(ids):
                    raise ValueError("the ids of joined pieces can't be told apart")
                order.append(group)
                sizes.append(size)
                flat.append(ids)
        alone = np.setdiff1d(np.arange(len(pieces)), fit)
        for at in range(0, len(alone), 64 * AT_ONCE):
            group = alone[at : at + 64 * AT_ONCE]
            encoded = self.encode([pieces[k].decode() for k in group])
            order.append(group)
            sizes.append(np.array(list(map(len, encoded)), np.int64))
            flat.append(np.array([x for ids in encoded for x in ids], np.uint32))
        return tuple(np.concatenate([np.zeros(0, t), *x]).astype(t) for t, x in ((np.int64, order), (np.int64, sizes), (np.uint32, flat)))

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text)."""
        words = W.split_words(data, bounds)
        starts, ends, text = words.starts, words.ends, words.text_of()
        if self.keep_blanks:
            # A piece begins where the one before it ends; blanks at a text's end are a piece of their own.
            head = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
            starts = np.where(head, bounds[text], np.r_[0, ends[:-1]]) if len(text) else starts
            last = bounds[:-1].copy()
            last[words.counts > 0] = ends[words.first[1:][words.counts > 0] - 1]
            tail = np.flatnonzero(last < bounds[1:])
            order = np.argsort(np.concatenate([text, tail]), kind="stable")
            starts, ends = np.concatenate([starts, last[tail]])[order], np.concatenate([ends, bounds[1:][tail]])[order]
            text = np.concatenate([text, tail])[order]
        odd = np.unique(np.searchsorted(bounds, odd_blanks(data), "right") - 1)
        if len(odd):
            whole = np.isin(text, odd)
            starts, ends, text = starts[~whole], ends[~whole], text[~whole]
        h = W.span_hash(data, starts, ends)
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        where = self._find(distinct)
        new = np.flatnonzero(where < 0)
        if len(new):
            self._learn(distinct[new], data, starts[first[new]], ends[first[new]])
            where = self._find(distinct)
            if (where < 0).any():  # more was dropped than the new: all of this slice's pieces go in again
                self._learn(distinct, data, starts[first], ends[first])
                where = self._find(distinct)
        piece = where[place]
        size = self.sizes[piece]
        out, owner = self.flat[W.ranges(self.at[piece], size)], np.repeat(text, size)
        if len(odd):
            extra = self.encode([data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in odd])
            out = np.concatenate([out, *[np.array(x, np.uint32) for x in extra]])
            owner = np.concatenate([owner, np.repeat(odd, list(map(len, extra)))])
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
        return out, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(bounds) - 1))]

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) and len(self.keys) + len(h) > REMEMBERED:
            self._forget()
        raw = data.tobytes()
        order, sizes, flat = self._pieces([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        at = len(self.flat) + np.cumsum(sizes) - sizes
        keys = np.concatenate([self.keys, h[order]])
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.at, self.sizes = keys[by_key], np.concatenate([self.at, at])[by_key], np.concatenate([self.sizes, sizes])[by_key]
        self.flat = np.concatenate([self.flat, flat])


def odd_blanks(data: np.ndarray) -> np.ndarray:
    """Bytes at which a white-space character beyond ASCII begins."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
    wide = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else at[:0]
    a, b, c = data[wide], data[wide + 1], data[np.minimum(wide + 2, len(data) - 1)]
    hit = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return np.concatenate([at, wide[hit]])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, keep_blanks: bool) -> Encoder:
    """One for each worker process."""
    key = (path, keep_blanks)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        _encoders[key] = Encoder(path, keep_blanks)
    return _encoders[key]

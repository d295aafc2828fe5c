"""Recompression of word sequences: rounds that name runs of one symbol, then pairs of symbols of two classes.

A name is a fingerprint of what it stands for, so every task gives equal words the same name with no table of names.
Which symbols merge depends on the symbols alone: equal word sequences have the same symbols inside, up to a margin that
they fix themselves. Taking off these margins round by round leaves each sequence with a list of symbols from all
levels, outer ones from low levels and inner ones from high levels, which is its name and no other's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import words as W

_U = np.uint64
_RUN, _PAIR, _OUTER, _INNER = (_U(x) for x in (0x9FB21C651E98DF25, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F))


@dataclass
class Level:
    """The symbols after a round, and how those below went into them.

    first[j] is the first symbol below that symbol j holds (one more at the end), made tells a new name from one that
    came up as it was; run is the run of each symbol below, left and symbol are the class of each run and the symbol
    that took it in.
    """

    names: np.ndarray
    text: np.ndarray
    first: np.ndarray
    made: np.ndarray
    run: np.ndarray
    left: np.ndarray
    symbol: np.ndarray


def rise(names: np.ndarray, text: np.ndarray, k: int) -> Level:
    """Round k (from 1) over the symbols of some texts; no symbol goes over a text's end."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.r_[at, len(names)])
    runs, whose = names[at], text[at]
    long = np.flatnonzero(many > 1)
    runs[long] = W.mix(runs[long] + many[long].astype(_U) * _RUN + _U(2 * k))
    left = ((runs if k <= 8 else W.mix(runs + _U(k))) >> _U(7 * min(k, 8)) & _U(1)).astype(bool)  # fingerprints' own bits first
    pair = np.zeros(len(runs), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (whose[:-1] == whose[1:])
    second = np.zeros(len(runs), bool)
    second[1:] = pair[:-1]
    begin = np.flatnonzero(~second)
    out, two = runs[begin], np.flatnonzero(pair[begin])
    out[two] = W.mix(runs[begin[two]] * _PAIR + W.mix(runs[begin[two] + 1]) + _U(2 * k + 1))
    return Level(out, whose[begin], np.r_[at[begin], len(names)], pair[begin] | (many[begin] > 1), np.cumsum(new) - 1, left, np.cumsum(~second) - 1)


def inside(level: Level, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, whether there are any) of the symbols of a level that sequences low..high (inclusive) of symbols below fix by themselves.

    A run at a sequence's edge may go on outside; a right symbol at its low edge, or a left one at its high edge, may
    merge with what is outside: the sequence gives them up.
    """
    low, high = level.run[low] + 1, level.run[high] - 1
    there = low <= high
    last = len(level.left) - 1
    low, high = np.minimum(low, last), np.maximum(high, 0)
    low, high = low + ~level.left[low], high - level.left[high]
    there &= low <= high
    return level.symbol[np.where(there, low, 0)], level.symbol[np.where(there, high, 0)], there


def levels_of(h: np.ndarray, text: np.ndarray, rounds: int) -> list[Level]:
    out: list[Level] = []
    for k in range(1, rounds + 1):
        out.append(rise(h, text, k))
        h, text = out[-1].names, out[-1].text
    return out


def sequence_names(h: np.ndarray, levels: list[Level], at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(innermost symbols, name) of the sequences of size words from each word of at.

    The name folds the list of symbols that the levels leave: what each round gave up on the left and on the right,
    and the innermost ones.
    """
    core, name = np.zeros(len(at), _U), np.zeros(len(at), _U)
    todo, low, high, below = np.arange(len(at)), at, at + size - 1, h
    for level in [*levels, None]:
        if level is None:
            there = np.zeros(len(todo), bool)
        else:
            lo, hi, there = inside(level, low, high)
        ends = ~there
        core[todo[ends]] = W.window_hash(below, low[ends], high[ends] + 1 - low[ends])
        name[todo[ends]] = W.mix(name[todo[ends]] * _INNER + core[todo[ends]])
        if level is None or not there.any():
            break
        todo, low, high, lo, hi = todo[there], low[there], high[there], lo[there], hi[there]
        left, right = level.first[lo], level.first[hi + 1]
        outer = W.mix(name[todo] * _OUTER + W.window_hash(below, low, left - low))
        name[todo] = W.mix(outer * _OUTER + W.window_hash(below, right, high + 1 - right))
        low, high, below = lo, hi, level.names
    return core, name


def any_in(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether any of flags low..high (exclusive) is set."""
    before = np.r_[0, np.cumsum(flags)]
    return before[high] > before[low]

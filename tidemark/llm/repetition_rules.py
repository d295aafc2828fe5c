"""Quality rules on repetition inside a text, measured on its suffix array of words.

Suffixes of each text are sorted by doubling: ranks by 1, 2, 4, ... words, where only suffixes that still tie go on.
The longest common prefix of neighbouring suffixes, read off the ranks from the longest doubling down, bounds the
intervals of maximal repeated substrings; at each word the larger of its two neighbours' values is the longest
substring from there that the text holds again. The union of those spans is what the text repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from . import words as W
from .batches import beside, map_beside, map_texts, rejoined

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def longest_repeats(words: W.Words, least: int) -> np.ndarray:
    """For each word the length in words of the longest substring that starts there and stands elsewhere in the same text too; 0 if under least."""
    n = len(words.starts)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    ends = np.repeat(words.first[1:], words.counts)
    _, group, size = np.unique(W.mix(words.hashes() ^ W.mix(words.text_of() + 1)), return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[group]
    live = np.flatnonzero(size[group] > 1)
    levels, step, tied = [rank], 1, None
    if least == 1:
        tied = live
    while len(live):
        after = live + step
        key = rank[live] * (n + 1) + np.where(after < ends[live], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, live = key[order], live[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        base = rank[live]
        outer = np.r_[True, base[1:] != base[:-1]]
        at = np.arange(len(live))
        begin = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[live] = base + begin - np.maximum.accumulate(np.where(outer, at, 0))
        levels.append(rank)
        step *= 2
        twin = ~fresh | np.r_[~fresh[1:], False]
        live = live[twin]
        if step <= least:
            tied = live
    if tied is None or not len(tied):
        return longest
    tied = tied[np.argsort(rank[tied], kind="stable")]
    a, b = tied[:-1].copy(), tied[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (a < ends[tied[:-1]]) & (b < ends[tied[1:]])
        same &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        common += same.astype(np.int64) << k
        a, b = a + (same.astype(np.int64) << k), b + (same.astype(np.int64) << k)
    most = np.maximum(np.r_[common, 0], np.r_[0, common])
    longest[tied] = np.where(most >= least, most, 0)
    return longest


def _measures(data: np.ndarray, bounds: np.ndarray, window: int, least: int) -> dict[str, np.ndarray]:
    words = W.split_words(data, bounds)
    longest = longest_repeats(words, min(window, least))
    out = {"n_words": words.counts}
    out["word_chars"] = W.run_sums(W.NOT_BLANK[data] & ((data & 0xC0) != 0x80), bounds)
    out["n_symbols"] = W.run_sums(SYMBOLS[data], bounds)
    lines = W.split_words(data, bounds, NOT_NEWLINE)
    spoken = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    text = lines.text_of()[spoken]
    line = W.mix(W.span_hash(data, lines.starts[spoken], lines.ends[spoken]) ^ W.mix(text + 1))
    _, first = np.unique(line, return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=words.texts) - np.bincount(text[first], minlength=words.texts)
    for name, size in (("n_repeat_words", window), ("n_covered", least)):
        at = np.flatnonzero(longest >= size)
        out[name] = W.run_sums(W.cover(len(longest), at, longest[at]), words.first)
    top = np.zeros(words.texts, np.int64)
    np.maximum.at(top, words.text_of(), np.where(longest >= least, longest, 0))
    out["longest_repeat"] = top
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


def _judge(window: int = 8, min_words: int = 20, most_repeated: float = 0.3, least: int = 6, most_covered: float = 0.4, most_longest: float = 0.25) -> Callable[[np.ndarray, np.ndarray], list]:
    def work(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        m = _measures(data, bounds, window, least)
        n = m["n_words"]
        m["base_failed"] = (n < min_words) | (100 * m["n_repeat_words"] > round(100 * most_repeated) * n)
        m["kept"] = ~m["base_failed"] & (100 * m["n_covered"] <= round(100 * most_covered) * n) & (100 * m["longest_repeat"] <= round(100 * most_longest) * n)
        return list(m.values())

    return work


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, min_words: int = 20,
    most_repeated: float = 0.3, least: int = 6, most_covered: float = 0.4, most_longest: float = 0.25,
) -> DataFrame:
    """Counts and a verdict for each text.

    Returns one row per input row: the id column; n_words (runs of characters other than blanks), word_chars (their
    code points), n_symbols (characters among # * $ % & | < >), n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words (words in windows of that many words found twice or more in the text), n_covered (words in
    repeated substrings of `least` words or more), longest_repeat (words of the longest of those), base_failed and
    kept.

    base_failed: fewer than min_words words, or n_repeat_words over the share most_repeated. A text is kept if it
    has not failed so, n_covered is at most the share most_covered of its words, and longest_repeat at most the share
    most_longest.

    Null or empty text: all counts 0, failed for want of words. A null id stays null; rows with equal ids are judged
    each on its own. Other columns are neither read nor kept. An empty table gives an empty table.
    """

    return map_texts(docs, id_col, text_col, _judge(window, min_words, most_repeated, least, most_covered, most_longest), COLUMNS)


def keep_by_rules(docs: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The rows that repetition_rules keeps, with all their columns as they are, whatever their names.

    Each row is judged by its own text, so equal rows stay or go together, and ids play no part. Null and empty texts have
    no words and go. An empty table gives an empty table.
    """
    return rejoined(docs, text_col, map_beside(beside(docs, text_col), _judge(**limits), COLUMNS, with_text=True).where("kept"), "text", changed=False)

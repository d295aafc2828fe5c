"""License wording in texts: phrases, and templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .batches import map_texts
from .license_texts import TEMPLATES

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MARK = re.compile(r"""<<(beginOptional|endOptional|var)((?:;[^;=>]+=(?:"[^"]*"|[^;">]*))*)>>""")
_FIELD = re.compile(r""";([^;=>]+)=(?:"([^"]*)"|([^;">]*))""")
_WORDS, _MATCH = re.compile(r"(\d+)-(\d+)"), re.compile(r"\.(?:([+*])|\{(\d+),(\d*)\})")
ANY = np.uint64(0)


def word_hashes(text: str) -> np.ndarray:
    data, bounds = W.buffers(pa.array([text], pa.string()))
    return W.split_words(data, bounds, W.ALPHANUMERIC).hashes(lower=True)


@dataclass(frozen=True)
class Span:
    """What a move out of a region asks for: its last so many words take low to high characters, those between them included."""

    words: int
    low: int
    high: int

    def holds(self, k: int, starts: np.ndarray, ends: np.ndarray) -> bool:
        return self.low <= int(ends[k - 1] - starts[k - self.words]) <= self.high


@dataclass
class Automaton:
    """States 0..n; words[s] are (hash, next) moves, ANY for any word; skips[s] moves (next, span or None) that take no word. The last state accepts."""

    words: list[list[tuple[int, int]]]
    skips: list[list[tuple[int, Span | None]]]
    loops: list[int] = field(default_factory=list)

    @classmethod
    def compile(cls, template: str) -> Automaton:
        """Raises ValueError where optional regions don't nest, or where all of the wording can be left out."""
        out, opened, place = cls([[]], [[]]), [], 0
        for mark in [*_MARK.finditer(template), None]:
            for h in word_hashes(template[place : mark.start() if mark else len(template)]):
                out._step(int(h))
            if mark is None:
                break
            place = mark.end()
            if mark[1] == "beginOptional":
                opened.append(len(out.words) - 1)
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                out.skips[opened.pop()].append((len(out.words) - 1, None))
            else:
                out._region({name: quoted or bare for name, quoted, bare in _FIELD.findall(mark[2])})
        if opened:
            raise ValueError("beginOptional without endOptional")
        if len(out.words) - 1 in out.reach({0}):
            raise ValueError("a template needs mandatory wording")
        return out

    def _region(self, fields: dict[str, str]) -> None:
        """Other words, as the mark's fields say how many."""
        begin = len(self.words) - 1
        if counted := _WORDS.fullmatch(fields.get("words", "")):
            least, most = map(int, counted.groups())
            for _ in range(most):
                self._step(int(ANY))
            for k in range(least, most):
                self.skips[begin + k].append((len(self.words) - 1, None))
            return
        found = _MATCH.fullmatch(fields.get("match", ""))
        if not found:
            raise ValueError(f"a region needs words=a-b, or match as .+, .* or .{{a,b}}: {fields}")
        low, high = int(found[2] or 0), int(found[3] or 0)
        if not high:  # any number of words
            if found[1] == "*" or found[2] == "0":
                self.skips[begin].append((len(self.words), None))
                self.words.append([])
                self.skips.append([])
            else:
                self._step(int(ANY))
            self.words[-1].append((int(ANY), len(self.words) - 1))
            self.loops.append(len(self.words) - 1)
            return
        most = (high + 1) // 2  # a word and what parts it from the next take two characters at least
        for _ in range(most):
            self._step(int(ANY))
        out = len(self.words)
        self.words.append([])
        self.skips.append([])
        if not low:
            self.skips[begin].append((out, None))
        for k in range(1, most + 1):
            self.skips[begin + k].append((out, Span(k, low, high)))

    def _step(self, h: int) -> None:
        self.words[-1].append((h, len(self.words)))
        self.words.append([])
        self.skips.append([])

    def reach(self, states: Iterable[int], allowed: Callable[[Span], bool] = lambda span: True) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += [n for n, span in self.skips[s] if span is None or allowed(span)]
        return out

    def firsts(self, depth: int) -> list[set[int] | None]:
        """Words that may stand first, second, ...; None from where any may, or where an end may come."""
        out: list[set[int] | None] = []
        states = self.reach({0})
        for _ in range(depth):
            moves = [m for s in states for m in self.words[s]]
            if any(h == ANY for h, _ in moves) or len(self.words) - 1 in states:
                break
            out.append({h for h, _ in moves})
            states = self.reach(n for _, n in moves)
        return out

    def match(self, h: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> int:
        """The most words from the first that the wording takes; 0 if it takes none. starts, ends: the words' characters, without which spans are not asked."""
        states, best, end = self.reach({0}), 0, len(self.words) - 1
        for k in range(len(h)):
            word = int(h[k])
            after = (n for s in states for g, n in self.words[s] if g == word or g == ANY)
            states = self.reach(after) if starts is None else self.reach(after, lambda span: span.holds(k + 1, starts, ends))  # noqa: B023
            if not states:
                break
            if end in states:
                best = k + 1
        return best

    def matches(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: list[int]) -> list[int]:
        """match from each of those words to the text's end.

        A template without loops takes no more words than it has states. For others one pass from the end on gives, for
        each state, the farthest end it can come to from each word: its cost is the text's length, whatever the number of
        places to start from.
        """
        n = len(self.words)
        if not self.loops:
            return [self.match(h[k : k + n], starts[k : k + n], ends[k : k + n]) for k in at]
        wanted = np.zeros(n, np.uint64)
        onward = np.zeros(n, bool)
        for s, moves in enumerate(self.words):
            for g, to in moves:
                if to == s + 1:
                    wanted[s], onward[s] = g, True
        free, loops = onward & (wanted == ANY), np.array(self.loops)
        edges = [(s, to, span) for s in reversed(range(n)) for to, span in self.skips[s]]  # always ahead
        best, out, first = np.full(n, -1, np.int64), {}, min(at)
        places = set(at)
        for k in range(len(h), first - 1, -1):
            now = np.full(n, -1, np.int64)
            if k < len(h):
                takes = free | (onward & (wanted == h[k]))
                now[:-1] = np.where(takes[:-1], best[1:], -1)
                now[loops] = np.maximum(now[loops], best[loops])
            now[-1] = k
            for s, to, span in edges:
                if now[to] > now[s] and (span is None or (k - span.words >= 0 and span.holds(k, starts, ends))):
                    now[s] = now[to]
            best = now
            if k in places:
                out[k] = max(0, int(best[0]) - k)
        return [out[k] for k in at]


def _places(h: np.ndarray, left: np.ndarray, sets: list[set[int] | None]) -> np.ndarray:
    """Words from which each set holds the word in its turn, within the text."""
    at = np.arange(len(h))
    for k, allowed in enumerate(sets):
        at = at[left[at] > k]
        word = h[at + k]
        at = at[np.logical_or.reduce([word == np.uint64(x) for x in allowed])]
    return at


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
) -> DataFrame:
    """License phrases and template wording in each text.

    Texts, phrases and templates are lower-cased (A-Z); words are runs of 0-9, a-z and characters beyond ASCII. A
    template matches where all its mandatory words stand in order, with only the optional and replaceable regions
    its markup allows between them: a region .+ or .* goes on for any number of words, one of .{a,b} has so many characters
    from its first word to its last. The longest match from a place counts, unless it lies in an earlier one of the template.

    Returns one row per input row: the id column, n_words, n_base (places where a phrase's words stand one after
    another), first_word and last_word (smallest and largest start of those, else null), base_labels and labels (of
    phrases; of both; distinct, sorted, comma-joined), score (share of the words inside any match of either) and
    matches (array of label, first, last word number exclusive).

    Null or empty text: 0 words, score 0.0, empty labels. Null or repeated ids: each row is judged on its own. Other
    columns are neither read nor kept. An empty table gives an empty table.
    """
    phrases = PHRASES if phrases is None else phrases
    known = [(word_hashes(p), label) for p, label in phrases.items()]
    automata = [(label, Automaton.compile(t)) for label, t in (TEMPLATES if templates is None else templates).items()]
    automata = [(label, a, a.firsts(4)) for label, a in automata]

    def work(data: np.ndarray, bounds: np.ndarray) -> list:
        words = W.split_words(data, bounds, W.ALPHANUMERIC)
        h, text, first = words.hashes(lower=True), words.text_of(), words.first
        left = np.repeat(first[1:], words.counts) - np.arange(len(h))
        spans: list[tuple[int, int, str, bool]] = []
        for wanted, label in known:
            if len(wanted):
                at = _places(h, left, [{int(x)} for x in wanted])
                spans += [(k, k + len(wanted), label, True) for k in at.tolist()]
        begins, closes = None, None
        for label, automaton, sets in automata:
            at = _places(h, left, sets)
            if not len(at):
                continue
            if begins is None:  # characters: bytes that don't go on with one
                count = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                begins, closes = count[words.starts], count[words.ends]
            for i in np.unique(text[at]):
                low, high = first[i], first[i + 1]
                mine = at[text[at] == i]
                took = np.array(automaton.matches(h[low:high], begins[low:high], closes[low:high], (mine - low).tolist()))
                far = 0
                for k, n in zip(mine[took > 0].tolist(), took[took > 0].tolist(), strict=True):
                    if k + n > far:  # else it lies in the one before
                        spans.append((k, k + n, label, False))
                        far = k + n
        inside = W.cover(len(h), np.array([s[0] for s in spans], np.int64), np.array([s[1] - s[0] for s in spans], np.int64))
        covered, n = W.run_sums(inside, first), words.counts
        own: dict[int, list] = {}
        for s in spans:
            own.setdefault(int(text[s[0]]), []).append(s)
        n_base, low, high, base_labels, labels = [0] * len(n), [None] * len(n), [None] * len(n), [""] * len(n), [""] * len(n)
        matches: list[list] = [[] for _ in n]
        for i, found in own.items():
            off = int(first[i])
            base = [s for s in found if s[3]]
            if base:
                n_base[i], low[i], high[i] = len(base), min(s[0] for s in base) - off, max(s[0] for s in base) - off
            base_labels[i] = ",".join(sorted({s[2] for s in base}))
            labels[i] = ",".join(sorted({s[2] for s in found}))
            matches[i] = [{"label": s[2], "first": s[0] - off, "last": s[1] - off} for s in sorted(found)]
        return [n, n_base, low, high, base_labels, labels, covered / np.maximum(n, 1), matches]

    return map_texts(
        docs, id_col, text_col, work,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,last:long>>",
    )

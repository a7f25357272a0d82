"""Licence scan with a generalised suffix automaton over the words of licence texts, notices and phrases.

Files are streamed through the automaton, which gives each word's matching statistic: the longest run of words ending
there that stands in some template. Places of a phrase are read off the automaton's states; long matches are chained, in
the order of the file and of the template, into covered spans, and a template is found wherever a chain covers enough of
it: the best chain first, then the best of what lies before and after it, and so on. Of templates found in one place the
one with most words covered stays, so a licence isn't taken for one that it contains or that differs from it in a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import map_rows, plain_documents, read_table
from waymark.llm.license_texts import NOTICES

#: (phrase, label): fixed values of the contract.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: A match of fewer words isn't chained.
MIN_MATCH = 3
#: Words that may lie between two matches of a chain.
MAX_GAP = 12
#: The share of a template's words that a chain must cover; of short ones so many words, or all.
COVERED, COVERED_WORDS = 0.7, 10
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class SuffixAutomaton:
    """Of several word sequences; each state keeps where in which sequence its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((k, at + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        copy = self._new(self.length[state] + 1)
        self.next[copy], self.link[copy] = dict(self.next[target]), self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:  # the word already follows, from another sequence
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._new(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return new

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        texts = [words_of(p) for p, _ in phrases] + [words_of(n) for _, n in notices]
        self.ids: dict[bytes, int] = {}
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in t] for t in texts]
        self.notices = [label for label, _ in notices]
        self.first_notice, self.sizes = len(phrases), [len(s) for s in sequences]
        self.needed = [max(-int(-COVERED * n // 1), min(n, COVERED_WORDS)) for n in self.sizes]
        self.automaton = SuffixAutomaton(sequences)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.link]  # those that end at a state, by its links too
        own = {}
        for sequence, (_, label) in zip(sequences, phrases, strict=False):
            own.setdefault(self.automaton.state_of(sequence), []).append((len(sequence), label))
        for state in range(len(self.phrases)):
            at = state
            while at > 0:
                self.phrases[state] += own.get(at, [])
                at = self.automaton.link[at]
        self.shortest = min([MIN_MATCH, *self.sizes])
        self.ends: dict[tuple[int, int], list[tuple[int, int]]] = {}  # no more than the automaton has transitions and states

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word."""
        state, length, a = 0, 0, self.automaton
        for word in ids:
            while state and word not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if (to := a.next[state].get(word)) is not None:
                state, length = to, length + 1
            yield state, length

    def ended(self, state: int, longer: int) -> list[tuple[int, int]]:
        """Where in templates the words of a state end that don't go on to the state longer (0: none does)."""
        if (state, longer) not in self.ends:
            goes_on = self.automaton.ends[longer] if longer else ()
            self.ends[state, longer] = sorted((s, e) for s, e in self.automaton.ends[state] if s >= self.first_notice and (s, e + 1) not in goes_on)
        return self.ends[state, longer]

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        get = self.ids.get
        known = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        bounds = np.flatnonzero(np.diff(np.r_[False, known >= 0, False]))
        starts, stops = bounds[::2], bounds[1::2]
        long = stops - starts >= self.shortest
        base: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            found = list(self.statistics(known[start:stop].tolist()))
            for k, (state, length) in enumerate(found):
                for size, label in self.phrases[state]:
                    if size <= length:
                        base.append((start + k + 1 - size, label))
                if length >= MIN_MATCH:
                    longer = found[k + 1][0] if k + 1 < len(found) and found[k + 1][1] == length + 1 else 0
                    for sequence, end in self.ended(state, longer):
                        matches.setdefault(sequence, []).append((start + k + 1, end, length))
        shares = [self._chained(own)[0] / self.sizes[s] for s, own in matches.items()]
        chains = [(*place, s) for s, own in matches.items() for place in self._places(own, self.needed[s])]  # (words covered, first word, word after the last, template)
        kept: list[tuple[int, int, str]] = []
        near: dict[int, list[tuple[int, int]]] = {}  # of those that stay, by runs of words
        for n, a, b, s in sorted(chains, key=lambda c: (-c[0], -c[0] / self.sizes[c[3]], c[3], c[1])):
            runs = range(a >> 6, (b >> 6) + 1)
            if all(2 * (min(b, y) - max(a, x)) <= b - a for r in runs for x, y in near.get(r, ())):  # at most half of it lies in one that stays
                kept.append((a, b, self.notices[s - self.first_notice]))
                for r in runs:
                    near.setdefault(r, []).append((a, b))
        base_labels = {label for _, label in base}
        labels = base_labels | {label for *_, label in kept}
        places = [start for start, _ in base]
        spans = ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(kept))
        return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), max([1.0 if base else 0.0, *shares]), spans

    @staticmethod
    def _chained(matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """The most words of the template that a chain of matches covers, its first word and the one after its last.

        matches: (end in the file, end in the template, length). Of equally good chains the first to end counts.
        """
        return max(Scanner._best_chains(sorted(set(matches))), key=lambda x: (x[0], -x[2]), default=(0, 0, 0))

    @staticmethod
    def _best_chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """For each match, by its end, the best chain that ends with it: words covered, first word, word after the last."""
        best: list[tuple[int, int, int]] = []
        for k, (end, of, length) in enumerate(matches):
            total, first = length, end - length
            for j in range(k - 1, -1, -1):
                end_j, of_j, length_j = matches[j]
                if end - length - end_j > MAX_GAP + length_j:  # matches are sorted by their ends
                    break
                new = min(length, end - end_j, of - of_j)  # words beyond the other match, in both
                if new > 0 and 0 <= end - new - end_j <= MAX_GAP and best[j][0] + new > total:
                    total, first = best[j][0] + new, best[j][1]
            best.append((total, first, end))
        return best

    @classmethod
    def _places(cls, matches: list[tuple[int, int, int]], needed: int) -> list[tuple[int, int, int]]:
        """All chains that cover enough words: the best, then the best of the matches that lie whole before it and after it, and so on."""
        found, pieces = [], [sorted(set(matches))]
        while pieces:
            own = pieces.pop()
            if sum(length for *_, length in own) < needed:
                continue
            best = cls._best_chains(own)
            most = max(total for total, _, _ in best)
            if most < needed:
                continue
            # Chains as good as the best that follow each other are what the search after each would find next.
            taken = []
            for total, first, end in best:
                if total == most:
                    if taken and first < taken[-1][2]:
                        if end > taken[-1][2]:
                            break
                        continue
                    taken.append((total, first, end))
            found += taken
            bounds = [0, *(x for _, first, end in taken for x in (first, end)), float("inf")]
            for lo, hi in zip(bounds[::2], bounds[1::2], strict=True):
                piece = [m for m in own if m[0] - m[2] >= lo and m[0] <= hi]
                if piece:
                    pieces.append(piece)
        return found


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each row of docs: its words, the places of the base phrases, the labels found, the best cover, and the
    covered spans as label:first word:word after the last.

    A null text counts as empty: no words, no places, empty labels and score 0. Repeated rows and null doc_ids each give
    a row; an empty table gives none. A very long text is streamed; a template is found at every place that covers
    enough of it. Of templates
    that cover a place equally well the first of the list stays. The automaton's size is that of phrases and templates.
    Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        if (phrases, notices) not in _scanners:
            _scanners[phrases, notices] = Scanner(phrases, notices)
        scanner = _scanners[phrases, notices]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_rows(plain_documents(docs, "doc_id", "text"), run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL: dict[str, str] = {}

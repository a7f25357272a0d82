"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream. At level k the stream is cut into blocks of 2^k words, and a completed block has a
catcher: it watches the next places at which its words might begin again, those 2^k to 2^(k+1) - 1 words after its own
start. So one catcher is live at each level, and an appended word completes one suffix of 2^k words at each level, which
is compared with that level's catcher. The hash of a suffix is made of two of the level below, kept in a delay line. A
suffix that matches at a distance p catches a square of period p if it keeps to it: catches of consecutive blocks at one
distance are a chain, which is closed by the first block that fails, then compared word by word with itself p words
later, extended to both sides, and merged into the run of the same stretch and the smallest period.

A stretch of four periods p, 2^k <= p < 2^(k+1), holds two consecutive blocks of 2^k words that both come again p words
later, so chains of fewer blocks are dropped. A hash can only add chains, which the words then refute.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import map_rows, plain_documents, read_table

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are appended at a time.
APPENDED = 1 << 17
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two suffixes, one after the other."""
    x = left * _MIX[0] + (right ^ (right >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class _Level:
    """The catchers of blocks of 2^k words."""

    def __init__(self, k: int):
        self.k = k
        #: Hashes of the last 2^k suffixes, for the level above; the first suffix not yet hashed.
        self.delayed, self.next = np.empty(0, np.uint64), 0
        self.blocks = np.empty(0, np.uint64)
        #: Catches of chains that are still open: the block's number and the distance.
        self.open = (np.empty(0, np.int64), np.empty(0, np.int64))

    def advance(self, suffixes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Takes the hashes of the suffixes that were completed; gives closed chains: first block, last block, distance."""
        k, at = self.k, np.arange(self.next, self.next + len(suffixes))
        self.next += len(suffixes)
        self.blocks = np.concatenate([self.blocks, suffixes[at & ((1 << k) - 1) == 0]])
        block = (at >> k) - 1
        caught = np.flatnonzero((block >= 0) & (suffixes == self.blocks[np.maximum(block, 0)]))
        yield from self._close(block[caught], at[caught] - (block[caught] << k), False)

    def _close(self, blocks: np.ndarray, distances: np.ndarray, ended: bool) -> Iterator[tuple[int, int, int]]:
        blocks, distances = np.concatenate([self.open[0], blocks]), np.concatenate([self.open[1], distances])
        order = np.lexsort((blocks, distances))
        blocks, distances = blocks[order], distances[order]
        first = np.flatnonzero(np.r_[True, (np.diff(distances) != 0) | (np.diff(blocks) != 1)]) if len(blocks) else blocks
        last = np.r_[first[1:], len(blocks)] - 1 if len(blocks) else blocks
        closed = ended | (((blocks[last] + 1) << self.k) + distances[last] < self.next)
        stays = np.repeat(~closed, last - first + 1)
        self.open = blocks[stays], distances[stays]
        long = closed & (last - first + 1 >= LEAST_PERIODS - 2)
        yield from zip(blocks[first[long]], blocks[last[long]], distances[first[long]], strict=True)

    def end(self) -> Iterator[tuple[int, int, int]]:
        yield from self._close(self.blocks[:0].astype(np.int64), self.blocks[:0].astype(np.int64), True)


class SquareCatcher:
    """append() words, by their numbers, as many at a time as there are; runs() after the last.

    longest: the length of the longest stretch that may hold a run, where it's known: larger levels are left out.
    The result doesn't depend on how the words are dealt to calls.
    """

    def __init__(self, longest: int | None = None):
        self.words, self.n = np.empty(1024, np.int64), 0
        self.longest = longest
        self.levels: list[_Level] = []
        #: The smallest period of each stretch, and the stretches by start.
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        words = np.asarray(words, dtype=np.int64)
        if not len(words):
            return
        if self.n + len(words) > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.empty(max(self.n, len(words)), np.int64)])
        self.words[self.n : self.n + len(words)] = words
        self.n += len(words)
        x = words.astype(np.uint64) * _MIX[2]
        suffixes, k = x ^ (x >> np.uint64(31)), 0
        while len(suffixes) and (self.longest is None or LEAST_PERIODS << k <= self.longest):
            if k == len(self.levels):
                self.levels.append(_Level(k))
            level = self.levels[k]
            self._catch(list(level.advance(suffixes)), k)
            known = np.concatenate([level.delayed, suffixes])  # the suffixes of the level above begin with these
            level.delayed = known[max(0, len(known) - (1 << k)) :]
            suffixes = _joined(known[: max(0, len(known) - (1 << k))], known[1 << k :])
            k += 1

    def _catch(self, chains: list[tuple[int, int, int]], k: int) -> None:
        """Chains of one level become runs. A chain within a run found before, at a multiple of its period, is that run again."""
        if not chains:
            return
        first, last, period = np.array(chains, dtype=np.int64).T
        start, end = first << k, ((last + 1) << k) + period
        new = np.ones(len(start), dtype=bool)
        if self.found:
            own = np.array([(a, b, p) for (a, b), p in self.found.items()], dtype=np.int64)
            own = own[np.argsort(own[:, 0], kind="stable")]
            reach = np.maximum.accumulate(own[:, 1])
            furthest = np.maximum.accumulate(np.where(own[:, 1] == reach, np.arange(len(own)), 0))
            at = np.searchsorted(own[:, 0], start, side="right") - 1
            over = own[furthest[np.maximum(at, 0)]]
            new = ~((at >= 0) & (over[:, 1] >= end) & (period % over[:, 2] == 0))
        for a, b, p in zip(start[new].tolist(), end[new].tolist(), period[new].tolist(), strict=True):
            if (a, b) in self.found and p % self.found[a, b] == 0:
                continue
            if stretch := self._extended(a, b - p, p, 1 << k):
                if stretch[1] - stretch[0] >= max(LEAST_WORDS, LEAST_PERIODS * p):
                    self.found[stretch] = min(p, self.found.get(stretch, p))

    def _extended(self, a: int, b: int, p: int, step: int) -> tuple[int, int] | None:
        """The stretch around words a to b, which are the same p words later; None if they aren't."""
        words, n = self.words, self.n
        if (words[a:b] != words[a + p : b + p]).any():
            return None
        while a > 0:
            lo = max(0, a - step)
            differ = np.flatnonzero(words[lo:a] != words[lo + p : a + p])
            if len(differ):
                a = lo + int(differ[-1]) + 1
                break
            a = lo
        while b + p < n:
            hi = min(n - p, b + step)
            differ = np.flatnonzero(words[b:hi] != words[b + p : hi + p])
            if len(differ):
                b += int(differ[0])
                break
            b = hi
        return a, b + p

    def runs(self) -> list[tuple[int, int, int]]:
        """Start, length and period of all runs, by start, then period. Call it once, after the last word."""
        for level in self.levels:
            self._catch(list(level.end()), level.k)
        return sorted((a, b - a, p) for (a, b), p in self.found.items())


def altered_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place, where a document's checksum says that its words repeat from some place on; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    values = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    return values.filter(pa.array(real)), np.r_[0, np.cumsum(real)][offsets - offsets[0]]


def run_rows(doc_ids: pa.Array, texts: pa.Array, altered: bool) -> pa.RecordBatch:
    words, bounds = _words(texts)
    n_docs, sizes = len(texts), np.diff(bounds)
    places, changed = np.arange(len(words)), False
    for k, doc_id in enumerate(doc_ids.to_pylist()):
        if altered and (own := altered_places(doc_id, int(sizes[k]))) is not None:
            places[bounds[k] : bounds[k + 1]] = bounds[k] + own
            changed = True
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)[places]
    catcher = SquareCatcher(int(sizes.max(initial=0)))
    # All documents are one stream, each followed by a number of its own, which no run can hold.
    stream = np.insert(numbers, bounds[1:], -1 - np.arange(n_docs))
    for at in range(0, len(stream), APPENDED):
        catcher.append(stream[at : at + APPENDED])
    starts = bounds[:-1] + np.arange(n_docs)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in catcher.runs():
        k = int(np.searchsorted(starts, start, side="right")) - 1
        runs.setdefault(k, []).append((start - int(starts[k]), length, period))
        kept[start - k + period : start - k + length] = False
    if changed or runs:
        ends = np.r_[0, np.cumsum(kept)][bounds]
        lists = pa.LargeListArray.from_arrays(pa.array(ends), words.take(pa.array(places[kept])))
    else:
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), words)
    collapsed = [hashlib.sha256(t.encode()).hexdigest() for t in pc.binary_join(lists, " ").to_pylist()]
    none = hashlib.sha256(b"").hexdigest()
    longest = [min(runs[k], key=lambda r: (-r[1], r[0], r[2])) if k in runs else (None, None, None) for k in range(n_docs)]
    digests = [hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs[k]).encode()).hexdigest() if k in runs else none for k in range(n_docs)]
    columns = [[len(runs.get(k, ())) for k in range(n_docs)], *zip(*longest, strict=True), [None if p is None else 1000 * m // p for _, m, p in longest]] if n_docs else [[]] * 5
    return pa.record_batch([doc_ids, *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(collapsed, pa.string())], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def find_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """Every document's runs: their number, the longest one, and digests of all runs and of the text without repeats.

    A run is a stretch of 6 words and 4 periods at least whose words equal those a smallest period later, and that no
    neighbouring word extends. Of runs of equal length the first is the longest, then the one of the smaller period. A
    word is dropped if a run holds it after its own first period. Every row of docs gives a row. Null, empty and blank
    texts have no words: no runs, nulls for the longest, and the digests of an empty string. Repeated rows each give a
    row; an empty table gives none. A very long text is one stream like others, appended in pieces. Only doc_id and text
    are read. altered: the words of documents are first repeated where the checksum of doc_id says so (not if it's null).
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield run_rows(batch.column("doc_id"), batch.column("text"), altered)

    return map_rows(plain_documents(docs, "doc_id", "text"), run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(read_table(spark, sf_dir, "documents"), altered=True)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict[str, str] = {}

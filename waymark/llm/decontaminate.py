"""Benchmark decontamination: a BM25 inverted index of the test items, searched with every passage of every document.

Scores are BM25 sums over a passage's distinct words, divided by the item's score for itself, so one threshold holds for
all items. Items lie in blocks; the index keeps each word's largest impact in each block. The bounds of a document's
passages are summed for all blocks at once, and only in blocks whose bound reaches the threshold are the posting lists
walked by WAND. Every item above the threshold is then verified by the overlap of its question and its answer.

Long items are indexed by parts, for retrieval alone: what is verified is always the whole item. Document frequencies and
the mean length are those of all items, whatever number of indexes they are dealt to.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import map_rows, plain_documents, read_table, written

K1, B = 1.2, 0.75
#: The share of an item's own score that a passage must reach.
THRESHOLD = 0.45
#: Word n-grams for the overlaps, and the shares of question and answer, or of both together, that confirm.
GRAM, QUESTION, ANSWER, TOGETHER = 3, 0.5, 0.5, 0.8
#: Items longer than this are indexed by parts of so many words.
PART_WORDS = 256
#: Parts, and words, of one index. Its dense table of words by blocks has 65,536 x 256 floats at most, 67 MB.
INDEX_ITEMS, INDEX_WORDS = 1024, 65_536
BLOCK_ITEMS = 4
#: Indexes are searched together, in one pass over the documents, up to so many bytes of their tables.
PASS_BYTES = 256_000_000
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TABLE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before the last line or else the last sentence, and the words of it; an item of one sentence has no answer."""
    text = text.strip()
    head, _, tail = text.rpartition("\n")
    if not head:
        head, _, tail = text.rstrip(".!?").rpartition(". ")
    return (words_of(head), words_of(tail)) if words_of(head) else (words_of(text), [])


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    question: list[bytes]
    answer: list[bytes]


def parts_of(item_id: int, text: str | None) -> list[Item]:
    """The item's words in parts of PART_WORDS, the last one up to half as long again; each with the whole question and answer."""
    question, answer = question_and_answer(text or "")
    words = question + answer
    cuts = [0, *range(PART_WORDS, len(words) - PART_WORDS // 2, PART_WORDS)]
    return [Item(item_id, words[a:b], question, answer) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True) if words[a:b]]


@dataclass
class Statistics:
    """Of all parts of all items: their number, mean and largest length, and for words the number of parts that hold them."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        lengths = [len(i.words) for i in items] or [0]
        return cls(len(items), sum(lengths) / len(lengths), max(lengths), Counter(w for i in items for w in set(i.words)))


class Index:
    """BM25 impacts of items, as posting lists by block and as block maxima. statistics: of all items; else of these."""

    def __init__(self, items: list[Item], statistics: Statistics | None = None):
        self.items = items
        stats = statistics or Statistics.of(items)
        counts = [Counter(i.words) for i in items]
        self.term_ids: dict[bytes, int] = {}
        for c in counts:
            for w in c:
                self.term_ids.setdefault(w, len(self.term_ids))
        idf = {w: math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) for w in self.term_ids}
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(idf), max(1, self.blocks)), dtype=np.float32)
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for k, (item, own) in enumerate(zip(items, counts, strict=True)):
            norm = K1 * (1 - B + B * len(item.words) / stats.mean)
            impact = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in own.items()}
            total = sum(impact.values())
            for w, x in impact.items():
                term, block = self.term_ids[w], k // BLOCK_ITEMS
                self.postings.setdefault((term, block), []).append((k, x / total))
                self.block_max[term, block] = max(self.block_max[term, block], x / total + 1e-7)
        self.stride = max(16, stats.longest)  # a passage is two strides long, so every part lies whole in one
        own_grams = lambda words: grams(words, min(GRAM, len(words))) if words else set()
        self.question = [own_grams(i.question) for i in items]
        self.answer = [own_grams(i.answer) for i in items]

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of a block whose score for the terms reaches the threshold."""
        lists = [(own, float(self.block_max[t, block])) for t in terms if (own := self.postings.get((t, block)))]
        cursors = [[own[0][0], 0, own, bound] for own, bound in lists]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= threshold:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += c[2][c[1]][1]
                if score >= threshold:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                while c[0] < target and c[1] < len(c[2]):
                    c[1] += 1
                    c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else -1
                    if c[0] < 0:
                        break
            cursors = [c for c in cursors if c[1] < len(c[2])]
        return out

    def candidates(self, words: list[bytes], threshold: float) -> dict[tuple[int, int], float]:
        """(passage, item) and score of what reaches the threshold; passage p has the words from p * stride, two strides long."""
        get = self.term_ids.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        strips = -(-len(words) // self.stride)
        keys = np.unique(at // self.stride * len(self.term_ids) + ids[at])  # distinct words of each strip
        strip, term = np.divmod(keys, len(self.term_ids))
        sums = np.zeros((strips + 1, self.block_max.shape[1]), dtype=np.float32)
        cuts = np.flatnonzero(np.diff(strip, prepend=-1))
        for lo in range(0, len(cuts), 256):  # a very long text isn't expanded as a whole
            hi = min(lo + 256, len(cuts))
            end = cuts[hi] if hi < len(cuts) else len(strip)
            sums[strip[cuts[lo:hi]]] = np.add.reduceat(self.block_max[term[cuts[lo] : end]], cuts[lo:hi] - cuts[lo], axis=0)
        bounds = sums[:-1] + sums[1:]
        found: dict[tuple[int, int], float] = {}
        passages, blocks = np.nonzero(bounds >= threshold)
        last, terms = -1, []
        for p, block in zip(passages.tolist(), blocks.tolist(), strict=True):
            if p != last:
                own = term[np.searchsorted(strip, p) : np.searchsorted(strip, p + 2)]
                last, terms = p, np.unique(own)
                exact = self.block_max[terms].sum(axis=0)  # words of both strips count once
            if exact[block] >= threshold:
                for item, score in self.wand(terms.tolist(), block, threshold):
                    found[p, item] = score
        return found

    def search(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage) of each verified item, its best passage."""
        words = words_of(text)
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for (p, k), score in self.candidates(words, threshold).items():
            beside = max(0, len(self.items[k].question) + len(self.items[k].answer) - len(self.items[k].words))  # the rest of a long item
            passage = words[max(0, p * self.stride - beside) : (p + 2) * self.stride + beside]
            own = {n: grams(passage, n) for n in range(1, GRAM + 1)}
            share = lambda wanted, own=own: len(wanted & own[len(next(iter(wanted)))]) / len(wanted) if wanted else 1.0
            q, a = share(self.question[k]), share(self.answer[k])
            n_q, n_a = len(self.question[k]), len(self.answer[k])
            if q >= QUESTION and a >= ANSWER or (q * n_q + a * n_a) / (n_q + n_a) >= TOGETHER:
                hit = (self.items[k].item_id, score, q, a, p * self.stride)
                best[hit[0]] = max(best.get(hit[0], hit), hit, key=lambda h: (h[1], -h[4]))
        return sorted(best.values())


def statistics_of(items: DataFrame) -> tuple[DataFrame, Statistics]:
    """(item_id, text, part, words, df), a row for each part, df with the number of parts that hold each of its distinct words; and the rest.

    items: (item_id, text); null texts and ids have nothing to search for, and a repeated item counts once.
    """
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [(i, t, k, own.words) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, own in enumerate(parts_of(i, t))]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())), strict=True)], ["item_id", "text", "part", "words"])

    parts = written(map_rows(rows, cut, "item_id bigint, text string, part int, words array<string>"), "parts")
    distinct = parts.select("item_id", F.xxhash64("text").alias("key"), "part", F.explode(F.array_distinct("words")).alias("word"))
    df = distinct.groupBy("word").agg(F.count("*").alias("n"))
    own = distinct.join(df, "word").groupBy("item_id", "key", "part").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("df"))  # PART_WORDS * 1.5 words at most
    total = parts.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("longest")).first()
    return parts.withColumn("key", F.xxhash64("text")).join(own, ["item_id", "key", "part"]).drop("key"), Statistics(total["n"], total["mean"] or 1.0, total["longest"] or 0, {})


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most INDEX_ITEMS parts and INDEX_WORDS words each, with the statistics of all items. A part is alone if it must be."""
    parts, stats = statistics_of(items)
    own: list[Item] = []
    df: dict[bytes, int] = {}
    size = 0
    for r in parts.orderBy("item_id", "text", "part").toLocalIterator():  # one index's parts at a time
        if own and (len(own) >= INDEX_ITEMS or size + len(r["words"]) > INDEX_WORDS):
            yield Index(own, replace(stats, df=df))
            own, df, size = [], {}, 0
        question, answer = question_and_answer(r["text"])
        own.append(Item(r["item_id"], [w.encode() for w in r["words"]], question, answer))
        df.update((w.encode(), x) for w, x in r["df"].items())
        size += len(r["words"])
    if own:
        yield Index(own, replace(stats, df=df))


def passes(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes that are searched together: PASS_BYTES of their tables at most, or one index."""
    own: list[Index] = []
    for index in indexes(items):
        if own and sum(i.block_max.nbytes for i in own) + index.block_max.nbytes > PASS_BYTES:
            yield own
            own = []
        own.append(index)
    if own:
        yield own


def search(own: list[Index], text: str | None, threshold: float) -> list[tuple[int, float, float, float, int]]:
    """Of several indexes; an item with parts in more than one counts by its best passage."""
    best: dict[int, tuple] = {}
    for hit in (h for index in own for h in index.search(text, threshold)):
        best[hit[0]] = max(best.get(hit[0], hit), hit, key=lambda h: (h[1], -h[4]))
    return sorted(best.values())


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, both overlaps and the passage's first word.

    Null and empty texts hold nothing; a repeated row of docs gives its rows again, a repeated item doesn't. A null doc_id
    stays null. Of equally good passages the first counts. A very long text is searched passage by passage, as a whole.
    Without docs or items there are no rows. Other columns don't matter. An item that two passes find is there once.
    """
    spark = docs.sparkSession
    rows = plain_documents(docs, "doc_id", "text")
    found, n = None, 0
    for own in passes(items):
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            row = TaskContext.get().partitionId() << 40
            for batch in batches:
                hits = [(row + k, d, *h) for k, (d, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)) for h in search(shared.value, t, threshold)]
                row += batch.num_rows
                columns = list(zip(*hits, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        hits = map_rows(rows, run, f"row bigint, {SCHEMA}")
        found, n = hits if found is None else found.unionByName(hits), n + 1
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    if n > 1:  # parts of a long item may lie in two passes
        best = F.max_by(F.struct("doc_id", "score", "question_overlap", "answer_overlap", "first_word"), F.struct("score", -F.col("first_word"))).alias("x")
        found = found.groupBy("row", "item_id").agg(best).select("x.doc_id", "item_id", "x.score", "x.question_overlap", "x.answer_overlap", "x.first_word")
    return found.drop("row")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item.

    Null and empty texts stay, repeated rows share their fate, an empty table stays empty, and without items all stay.
    """
    for own in passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            for batch in batches:
                yield batch.filter(pa.array([not search(shared.value, t, threshold) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = map_rows(docs, run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL: dict[str, str] = {}

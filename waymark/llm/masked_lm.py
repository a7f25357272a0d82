"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

Texts are split once: a block of them is written as numbers into the block's own list of words, and the list with its
counts. All words are counted over the whole corpus. The most frequent ones have a slot of their own, the rest share
slots by hash; within a shared slot each word has its share of the slot's count. The network adds up embeddings of the
words on either side, by position, and predicts the middle word in three steps, its class, the slot within the class and
the word within the slot, so that probabilities are exact and every word has its own. Documents are dealt by a hash into
shards of about SHARD_TOKENS; in each of ROUNDS every shard trains a copy on its share of all its tokens, and Spark
averages the copies, weighted by their tokens. So scores depend on the rows alone, not on how a table is partitioned. A
document's score is the sum of its conditional log-probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import ship
from waymark.llm.common import map_rows, plain_documents, read_table, small_batches, written

#: Slots of one word each, and slots that all other words share by hash. Together CLASSES * PER_CLASS.
KNOWN, HASHED = 768, 256
CLASSES, PER_CLASS = 32, 32
VOCABULARY = KNOWN + HASHED
PAD = VOCABULARY
SIDE = 2
WIDTH = 16
ROUNDS = 2
RATE = 0.15
TRAIN_TOKENS = 2048
SCORE_TOKENS = 8192
#: A shard's texts are put together until there are so many tokens, then trained on by steps.
RUN_TOKENS = 65_536
#: Tokens of a shard, and shards that one task trains, one after the other.
SHARD_TOKENS, TASK_SHARDS = 1_000_000, 16
#: Words' log shares are added up as whole numbers of this many to one, so that the order of rows doesn't matter.
UNITS = 1e9
#: A block of texts ends beyond so many distinct words (numbers of words have 24 bits), or tokens; its list of words is written in rows of so many.
BLOCK_WORDS, BLOCK_TOKENS, LIST_WORDS = 500_000, 8_000_000, 20_000
#: Weights of the network in a row that is averaged.
BLOCK = 1024
SHAPES = {
    "embed": (2 * SIDE, VOCABULARY + 1, WIDTH),
    "bias": (WIDTH,),
    "class_out": (WIDTH, CLASSES),
    "class_bias": (CLASSES,),
    "word_out": (CLASSES, WIDTH, PER_CLASS),
    "word_bias": (CLASSES, PER_CLASS),
}


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Numbered(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        return k


class Tokens:
    """Slots of words, for looking at single texts."""

    def __init__(self, words: list[str]):
        self.ids = {w: k for k, w in enumerate(words)}

    def encode(self, text: str | None) -> np.ndarray:
        return np.array([self.ids[w] if w in self.ids else KNOWN + zlib.crc32(w.encode()) % HASHED for w in words_of(text)], dtype=np.int32)


def code_texts(docs: DataFrame) -> DataFrame:
    """A table of two kinds of rows: a document's numbers in its block's list of words, and parts of that list with counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        block, words, counts, tokens = TaskContext.get().partitionId() << 32, Numbered(), np.zeros(0, dtype=np.int64), 0

        def listed():
            names, totals = list(words), counts[: len(words)]
            for lo in range(0, len(names), LIST_WORDS):
                part = names[lo : lo + LIST_WORDS]
                yield pa.record_batch([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([lo], pa.int32()), pa.array([part]), pa.array([totals[lo : lo + LIST_WORDS]], pa.list_(pa.int64()))], CODED)

        for batch in batches:
            coded = []
            for text in batch.column("text").to_pylist():
                own = words_of(text)
                coded.append(np.fromiter(map(words.__getitem__, own), dtype=np.int32, count=len(own)))
            if len(counts) < len(words):
                counts = np.r_[counts, np.zeros(2 * len(words) - len(counts), dtype=np.int64)]
            seen = np.bincount(np.concatenate(coded)) if coded else np.zeros(0, dtype=np.int64)
            counts[: len(seen)] += seen
            n = len(coded)
            yield pa.record_batch([pa.array([block] * n, pa.int64()), batch.column("doc_id"), batch.column("text_hash"), pa.array([packed(c) for c in coded], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], CODED)
            tokens += sum(map(len, coded))
            if len(words) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                yield from listed()
                block, words, counts, tokens = block + 1, Numbered(), np.zeros(0, dtype=np.int64), 0
        yield from listed()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    with small_batches(docs.sparkSession):
        return written(map_rows(rows, run, "block bigint, doc_id bigint, text_hash bigint, codes binary, first int, words array<string>, counts array<bigint>"), "coded")


CODED = ["block", "doc_id", "text_hash", "codes", "first", "words", "counts"]


def listed_words(coded: DataFrame) -> DataFrame:
    """(block, code, word, n) of every block's words."""
    lists = coded.filter("words IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    return lists.select("block", (F.col("first") + F.col("at")).alias("code"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))


def totalled(coded: DataFrame) -> DataFrame:
    """The blocks' words with the word's count in all texts, total, as a table; one row of each word is its first.

    Counts are added up before they meet, so a common word is a row of each task. The totals are written, and so join the
    blocks' words as a plain scan: Spark can split the rows of a word that very many blocks have.
    """
    lists = listed_words(coded)
    totals = written(lists.groupBy("word").agg(F.sum("n").alias("total"), F.min("block").alias("first_block")), "word-totals")
    return written(lists.join(totals, "word").withColumn("first", F.col("block") == F.col("first_block")).drop("first_block"), "totals")


def counts_of(totals: DataFrame) -> DataFrame:
    """(word, n) of every word."""
    return totals.filter("first").select("word", F.col("total").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all texts."""
    return counts_of(totalled(code_texts(docs)))


def known_words(counts: DataFrame) -> list[str]:
    """The KNOWN most frequent words; of equal counts the first in order."""
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]


def count_words(docs: DataFrame) -> list[str]:
    return known_words(word_counts(docs))


def placed_words(rows: DataFrame, words: list[str]) -> DataFrame:
    """rows (word, n, total, ...) with slot and share, the logarithm of the word's share of the slot's count in UNITS, or null for a slot of its own.

    The n of all rows of a word add up to its total.
    """
    known = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(words)), "own int, word string"))  # KNOWN rows
    placed = rows.join(known, "word", "left").withColumn("slot", F.coalesce("own", F.lit(KNOWN) + (F.crc32("word") % HASHED).cast("int")))
    of_slot = F.broadcast(placed.filter("own IS NULL").groupBy("slot").agg(F.sum("n").alias("of_slot")))  # HASHED rows at most
    share = F.when(F.col("own").isNull(), F.round(F.log(F.col("total") / F.col("of_slot")) * UNITS).cast("bigint"))
    return placed.join(of_slot, "slot", "left").withColumn("share", share).drop("own", "of_slot")


def word_shares(counts: DataFrame, words: list[str]) -> DataFrame:
    """(word, share) of every word that shares a slot."""
    return placed_words(counts.withColumn("total", F.col("n")), words).filter("share IS NOT NULL").select("word", "share")


class Network:
    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([(rng.normal(0, 0.1, shape) if "bias" not in name else np.zeros(shape)).ravel() for name, shape in SHAPES.items()]).astype(np.float32)
        self.flat = flat.astype(np.float32, copy=True)
        self.memory = np.full_like(self.flat, 1e-4)
        self.p, self.m, at = {}, {}, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            self.p[name], self.m[name] = self.flat[at : at + size].reshape(shape), self.memory[at : at + size].reshape(shape)
            at += size

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.repeat(self.p["bias"][None], len(around), axis=0)
        for k in range(2 * SIDE):
            total += self.p["embed"][k][around[:, k]]
        return np.tanh(total)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        """Of each row, in place; returns the logarithms of the sums, plus the rows' largest scores."""
        top = x.max(axis=1, keepdims=True)
        x -= top
        np.exp(x, out=x)
        total = x.sum(axis=1, keepdims=True)
        x /= total
        return (np.log(total) + top)[:, 0]

    @staticmethod
    def _by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the rows by class, and (class, from, to) of each class in it."""
        own = (targets // PER_CLASS).astype(np.uint8)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(CLASSES + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(pairwise(cuts)) if b > a]

    def _scores(self, hidden: np.ndarray, classes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all classes, and of the slots of each row's own class; rows in the order of classes."""
        slots = np.empty((len(hidden), PER_CLASS), dtype=np.float32)
        for c, a, b in classes:
            np.matmul(hidden[a:b], self.p["word_out"][c], out=slots[a:b])
            slots[a:b] += self.p["word_bias"][c]
        return hidden @ self.p["class_out"] + self.p["class_bias"], slots

    def log_probabilities(self, around: np.ndarray, targets: np.ndarray) -> np.ndarray:
        order, classes = self._by_class(targets)
        targets, rows = targets[order], np.arange(len(targets))
        by_class, slots = self._scores(self._hidden(around[order]), classes)
        own = by_class[rows, targets // PER_CLASS] + slots[rows, targets % PER_CLASS]
        out = np.empty(len(targets), dtype=np.float32)
        out[order] = own - self._softmax(by_class) - self._softmax(slots)
        return out

    def _step(self, name: str, grad: np.ndarray) -> None:
        self.m[name] += grad * grad
        self.p[name] -= RATE * grad / np.sqrt(self.m[name])

    def train(self, around: np.ndarray, targets: np.ndarray) -> None:
        """One step of Adagrad on a batch; rows are put in the order of their classes."""
        n, (order, classes) = np.float32(len(targets)), self._by_class(targets)
        around, targets, rows = around[order], targets[order], np.arange(len(targets))
        hidden = self._hidden(around)
        d, e = self._scores(hidden, classes)
        for x, at in ((d, targets // PER_CLASS), (e, targets % PER_CLASS)):  # softmax less one at the true entry
            self._softmax(x)
            x[rows, at] -= 1
            x /= n
        d_hidden = d @ self.p["class_out"].T
        grads = {"class_out": hidden.T @ d, "class_bias": d.sum(axis=0), "word_out": np.zeros_like(self.p["word_out"]), "word_bias": np.zeros_like(self.p["word_bias"])}
        for c, a, b in classes:
            grads["word_out"][c], grads["word_bias"][c] = hidden[a:b].T @ e[a:b], e[a:b].sum(axis=0)
            d_hidden[a:b] += e[a:b] @ self.p["word_out"][c].T
        d_hidden *= 1 - hidden * hidden
        grads["bias"], grads["embed"] = d_hidden.sum(axis=0), np.zeros_like(self.p["embed"])
        for k in range(2 * SIDE):
            order = np.argsort(around[:, k].astype(np.uint16), kind="stable")
            own = around[order, k]
            firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            grads["embed"][k][own[firsts]] = np.add.reduceat(d_hidden[order], firsts, axis=0)
        for name, grad in grads.items():
            self._step(name, grad)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For every token of the texts (as ids): the ids around it, PAD beyond the ends; and its own id."""
    gap = np.full(SIDE, PAD, dtype=np.int32)
    line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    at = np.flatnonzero(line != PAD)
    steps = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    return np.asfortranarray(np.stack([line[at + s] for s in steps], axis=1)), line[at]


def packed(codes: np.ndarray) -> bytes:
    """Three bytes of each number, all lowest ones first, so that they compress well."""
    return codes.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def encode_coded(coded: DataFrame, totals: DataFrame, words: list[str]) -> DataFrame:
    """Every row's shard, doc_id, ids as 16-bit integers, and summed log shares, by shard: a table in the shared folder.

    Each block's words get their slots and meet the block's documents again.
    """
    spark = coded.sparkSession
    slots = placed_words(totals, words).select(F.col("block").alias("of_block"), "code", "slot", F.coalesce("share", F.lit(0).cast("bigint")).alias("share"))
    documents = coded.filter("words IS NULL").select("block", "doc_id", "text_hash", "codes")

    def run(own: pa.Table, lists: pa.Table) -> pa.Table:
        code = lists.column("code").to_numpy()
        slot_of, share_of = np.zeros(len(code), dtype=np.uint16), np.zeros(len(code), dtype=np.int64)
        slot_of[code], share_of[code] = lists.column("slot").to_numpy(), lists.column("share").to_numpy()
        ids, within = [], []
        for codes in own.column("codes").to_pylist():
            at = unpacked(codes)
            ids.append(slot_of[at].tobytes())
            within.append(int(share_of[at].sum()))
        return pa.table({"doc_id": own.column("doc_id"), "text_hash": own.column("text_hash"), "ids": pa.array(ids, pa.binary()), "within": pa.array(within, pa.int64())})

    ship.ensure(spark)
    found = documents.groupBy("block").cogroup(slots.groupBy("of_block")).applyInArrow(run, "doc_id bigint, text_hash bigint, ids binary, within bigint")
    shards = -(-(totals.agg(F.sum("n")).first()[0] or 1) // SHARD_TOKENS)
    tasks = -(-shards // TASK_SHARDS)
    tasks = min(shards, max(tasks, 2 * spark.sparkContext.defaultParallelism))  # a shard is in one task, whatever their number
    sharded = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int"))
    return written(sharded.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "text_hash", "doc_id"), "encoded")


def encode_documents(docs: DataFrame, words: list[str]) -> DataFrame:
    coded = code_texts(docs)
    return encode_coded(coded, totalled(coded), words)


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint16).astype(np.int32) for x in batch.column("ids").to_pylist()]


def train_round(encoded: DataFrame, flat: np.ndarray, turn: int, turns: int) -> np.ndarray:
    """Every shard trains a copy of the network on its batches of this turn; returns their mean by tokens.

    Over all turns each token of each text is trained on once. A task adds up its shards' copies.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(flat)

    def trained(texts: Iterator[np.ndarray]) -> tuple[Network, int]:
        network, n, held, size = Network(shared.value), 0, [], 0

        def learn() -> None:
            around, targets = windows(held)
            for lo in range(turn * TRAIN_TOKENS, len(targets), turns * TRAIN_TOKENS):
                network.train(around[lo : lo + TRAIN_TOKENS], targets[lo : lo + TRAIN_TOKENS])

        for text in texts:
            held.append(text)
            size, n = size + len(text), n + len(text)
            if size >= RUN_TOKENS:
                learn()
                held, size = [], 0
        if held:
            learn()
        return network, n

    def run(batches: Iterator[pa.RecordBatch]):
        rows = ((shard, text) for batch in batches for shard, text in zip(batch.column("shard").to_pylist(), _texts(batch), strict=True))
        total, n = np.zeros(len(flat)), 0
        for _, own in groupby(rows, key=itemgetter(0)):
            network, tokens = trained(text for _, text in own)
            total += tokens * network.flat.astype(np.float64)
            n += tokens
        if n:
            blocks = [total[lo : lo + BLOCK] for lo in range(0, len(total), BLOCK)]
            part = TaskContext.get().partitionId() % parts
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "part", "n", "weights"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w, dtype=np.float64) for w in group.column("weights").to_pylist())
        return pa.table({"block": group.column("block")[:1], "n": pa.array([pc.sum(group.column("n")).as_py()]), "weights": pa.array([total.tobytes()], pa.binary())})

    # Tasks' sums are added by parts, then the parts': neither step has more rows in a group than the root of their number.
    parts = math.isqrt(max(1, encoded.rdd.getNumPartitions() - 1)) + 1
    schema = "block int, n bigint, weights binary"
    copies = map_rows(encoded.select("shard", "ids"), run, "block int, part int, n bigint, weights binary")
    by_part = copies.groupBy("block", "part").applyInArrow(added, schema)
    found = by_part.groupBy("block").applyInArrow(added, schema).collect()  # one network
    return np.concatenate([(np.frombuffer(r["weights"], dtype=np.float64) / r["n"]).astype(np.float32) for r in sorted(found, key=lambda r: r["block"])]) if found else flat


def score_texts(texts: list[np.ndarray], network: Network) -> list[float]:
    sizes = [len(t) for t in texts]
    around, targets = windows(texts)
    logs = [network.log_probabilities(around[lo : lo + SCORE_TOKENS], targets[lo : lo + SCORE_TOKENS]) for lo in range(0, len(targets), SCORE_TOKENS)]
    sums = np.r_[0, np.cumsum(np.concatenate(logs, dtype=np.float64) if logs else np.empty(0))]
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]).tolist()


def train_model(encoded: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    flat = Network().flat
    for turn in range(rounds):
        flat = train_round(encoded, flat, turn, rounds)
    return flat


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, the summed log-probability, and its mean for each token.

    A null or empty text has no tokens, the sum 0 and a null mean. Repeated rows and null doc_ids each give a row, and
    repeated rows train as often. An empty table gives no rows. A very long text is trained on and scored as a whole, in
    steps. Only doc_id and text are read.
    """
    coded = code_texts(plain_documents(docs, "doc_id", "text"))
    totals = totalled(coded)
    encoded = encode_coded(coded, totals, known_words(counts_of(totals)))
    shared = docs.sparkSession.sparkContext.broadcast(train_model(encoded, rounds))

    def run(batches: Iterator[pa.RecordBatch]):
        network = Network(shared.value)
        for batch in batches:
            texts = _texts(batch)
            sums = np.array(score_texts(texts, network) if texts else []) + batch.column("within").to_numpy() / UNITS
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    found = map_rows(encoded.select("doc_id", "ids", "within"), run, "doc_id bigint, n_tokens bigint, log_likelihood double")
    return found.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_masked_lm": op2_masked_lm}
ORACLE_SQL: dict[str, str] = {}

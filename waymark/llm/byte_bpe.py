"""Byte-level BPE encoding and decoding by merge replay over all distinct pieces of a block of the corpus.

Every piece of the pre-tokenizer's pattern is independent of the rest of its text. So the texts of a partition are
cut into chunks, each distinct chunk is split by the pattern once, and the distinct new pieces of a block of texts are
encoded together: an inverted index maps the rank of a token pair to its positions in the concatenated pieces, the
merges are applied in rank order, and after each merge only the two pairs beside it are looked up anew. Rows never
leave their partition: there is no shuffle. A worker's memory is bounded by the block, the memo and the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.chunks import Cut, Memo
from waymark.llm.common import map_rows, plain_documents, read_table

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Texts are encoded in blocks of about so many characters.
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of a rank file, and the rank of every mergeable pair of tokens in sorted arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = len(self.tokens)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merged token, or -1."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once in each worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_one(piece: bytes, vocab: Vocabulary) -> list[int]:
    """One piece by itself: the lowest rank first, leftmost among equals."""
    ids = vocab.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    rank_of = lambda a, b: int(vocab.rank_of_pairs(np.array([a]), np.array([b]))[0])
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(vocab.rank_of_pairs(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()) if r >= 0]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or rank_of(ids[i], ids[after[i]]) != rank:
            continue
        j = after[i]
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank_of(rank, ids[after[i]])) >= 0:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := rank_of(ids[before[i]], rank)) >= 0:
            heapq.heappush(heap, (r, before[i]))
    return [x for x, keep in zip(ids, alive, strict=True) if keep]


def replay_merges(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Encode distinct pieces together; returns each piece's ids as little-endian unsigned 32-bit integers.

    The index holds, for each rank, arrays of positions whose pair has that rank. Ranks are taken in ascending order
    from a heap; all positions of a rank are merged at once, and of overlapping ones the leftmost, as one piece by
    itself would. Where a merge makes a pair of a lower rank than its own (which a trained vocabulary hardly has),
    the piece is encoded by itself instead.
    """
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return [b""] * len(pieces)
    ids = np.empty(n + 1, dtype=np.int32)
    ids[:n] = vocab.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    ids[n] = -1
    piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    after = np.arange(1, n + 2, dtype=np.int32)
    after[ends[lengths > 0] - 1] = n  # n stands for no neighbour
    after[n] = n
    before = np.arange(-1, n, dtype=np.int32)
    before[starts[lengths > 0]] = n
    alive = np.ones(n + 1, dtype=bool)
    alive[n] = False
    odd = np.zeros(len(pieces), dtype=bool)
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    waiting: list[int] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
            if rank not in index:
                heapq.heappush(waiting, rank)
            index[rank].append(part)

    left = np.flatnonzero(after[:n] < n).astype(np.int32)
    ranks = vocab.rank_of_pairs(ids[left], ids[after[left]])
    if (ranks >= 0).any():
        add(left[ranks >= 0], ranks[ranks >= 0])
    while waiting:
        rank = heapq.heappop(waiting)
        found = index.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[alive[at] & (after[at] < n)]
        if len(at):
            at = at[vocab.rank_of_pairs(ids[at], ids[after[at]]) == rank]
        if not len(at):
            continue
        if len(at) > 1:
            at.sort()
            linked = np.r_[False, after[at[:-1]] == at[1:]]  # overlaps the position before it
            if linked.any():
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
        gone = after[at]
        ids[at] = rank
        alive[gone] = False
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at][inner]] = at[inner]
        touched = np.concatenate([at[inner], before[at][before[at] < n]])
        if len(touched):
            if len(at) > 1:
                touched = np.unique(touched)
            ranks = vocab.rank_of_pairs(ids[touched], ids[after[touched]])
            if (early := (ranks >= 0) & (ranks < rank)).any():
                odd[piece_of[touched[early]]] = True
            if (fresh := ranks > rank).any():
                add(touched[fresh], ranks[fresh])
    flat = ids[:n][alive[:n]].astype("<u4")
    cuts = np.r_[0, np.cumsum(np.bincount(piece_of[alive[:n]], minlength=len(pieces)))] * 4
    data, cuts = flat.tobytes(), cuts.tolist()
    out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for k in np.flatnonzero(odd).tolist():
        out[k] = np.array(encode_one(pieces[k], vocab), dtype="<u4").tobytes()
    return out


class BlockEncoder:
    """Encodes blocks of texts; remembers chunks between blocks, within a number of bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocab, self.find = vocabulary(path), regex.compile(pattern).findall
        self.chunks = Memo(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.find(c) for c in chunks]
        pieces = list({p for own in split for p in own})
        coded = dict(zip(pieces, replay_merges([p.encode() for p in pieces], self.vocab), strict=True))
        return [coded[own[0]] if len(own) == 1 else b"".join([coded[p] for p in own]) for own in split]

    def encode(self, block: list[Cut]) -> Iterator[list[bytes]]:
        """For each array of texts of the block, the ids of each text as little-endian unsigned 32-bit integers."""
        self.chunks.learn({c for own in block for c in own.chunks()})
        for own in block:
            yield own.ids(self.chunks.known, np.dtype("<u4"))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[tuple[str, str], BlockEncoder] = {}


def encoder(path: str, pattern: str) -> BlockEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BlockEncoder(path, pattern)
    return _encoders[path, pattern]


def in_blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list[pa.Array], list[Cut]]]:
    """(doc ids, texts by chunks) of blocks of batches; a null text counts as empty."""
    ids, block, size = [], [], 0
    for batch in batches:
        texts = batch.column("text")
        ids.append(batch.column("doc_id"))
        block.append(Cut(texts))
        size += pc.sum(pc.binary_length(texts)).as_py() or 0
        if size >= chars:
            yield ids, block
            ids, block, size = [], [], 0
    if ids:
        yield ids, block


def encode_texts(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) of every row: the encoding itself.

    A null or empty text has no ids; repeated rows and null doc_ids each give a row; an empty table gives none.
    """

    def run(batches):
        coder = encoder(path, pattern)
        for ids, block in in_blocks(batches):
            for own, coded in zip(ids, coder.encode(block), strict=True):
                yield pa.record_batch([own, pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_rows(plain_documents(docs, "doc_id", "text"), run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data (binary) of rows (doc_id, ids); ids that are null give null."""

    def run(batches):
        tokens = vocabulary(path).tokens
        for batch in batches:
            data = [None if ids is None else b"".join([tokens[i] for i in ids]) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id bigint, data binary")


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    One row for each row of docs, repeated ones and null doc_ids included. A null or empty text has no tokens and
    the digests of nothing. An empty table gives an empty result. A very long text is one block by itself; its chunks are
    still encoded apart. Only doc_id and text are read.
    """
    path = path or public_tokenizers.path(RANKS_FILE)

    def run(batches):
        coder = encoder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for ids, block in in_blocks(batches):
            for own, coded in zip(ids, coder.encode(block), strict=True):
                yield pa.record_batch(
                    [own, pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array([sha(coder.decode(x)) for x in coded], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_rows(plain_documents(docs, "doc_id", "text"), run, SCHEMA)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL: dict[str, str] = {}

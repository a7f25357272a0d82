"""Texts cut into chunks: equal to encoding whole texts, whatever white space and marks they hold; slices of batches."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from waymark.llm import byte_bpe, chunks, common, token_files

PARTS = ["a", "Bc", "né", "日", "1", "22", ".", ",", "..", "'s", "'", ")", "#", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x01", "\x1c", "\x85", "\xa0", " ", "🎉", "\x01,", "<|endoftext|>"]


def texts(n=400):
    rng = np.random.default_rng(4)
    return [None, "", " ", "\n", *("".join(rng.choice(PARTS, rng.integers(1, 25), p=None)) for _ in range(n))]


def test_chunks_are_apart():
    lib = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER_FILE))
    own = texts()
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in own]
    coder = token_files.ChunkEncoder(public_tokenizers.path(token_files.TOKENIZER_FILE))
    for _ in range(2):  # the second time all chunks are remembered
        assert [np.frombuffer(x, dtype=coder.type).tolist() for x in coder.encode(pa.array(own))] == want
    plain = [t for t in own if not t or "<|" not in t]
    bpe = byte_bpe.BlockEncoder(public_tokenizers.path(byte_bpe.RANKS_FILE))
    bpe.chunks.limit = 1000  # forgets often
    block = [chunks.Cut(pa.array(plain[k : k + 50], pa.string())) for k in range(0, len(plain), 50)]
    got = [np.frombuffer(x, dtype="<u4").tolist() for one in block for own_ids in bpe.encode([one]) for x in own_ids]
    whole = [np.frombuffer(b"".join(byte_bpe.replay_merges([p.encode() for p in bpe.find(t or "")], bpe.vocab)), dtype="<u4").tolist() for t in plain]
    assert got == whole


def test_long_texts_in_runs(monkeypatch):
    monkeypatch.setattr(chunks, "GATHERED", 7)
    cut = chunks.Cut(pa.array(["one two three four five six", "", "x  y", "a b c d e f g h i j k l m n", None, "z"]))
    known = {c: c.encode() for c in cut.chunks()}
    assert cut.ids(known, np.dtype("u1")) == [b"one two three four five six", b"", b"x  y", b"a b c d e f g h i j k l m n", b"", b"z"]


def test_slices_hold_every_row(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 100)
    monkeypatch.setattr(common, "SLICE_ROWS", 7)
    rows = [("x" * (k * 37 % 300) if k % 5 else None, k) for k in range(100)]
    batch = pa.record_batch([pa.array([t for t, _ in rows]), pa.array([k for _, k in rows])], ["text", "k"])
    parts = list(common.in_slices([batch, batch.slice(0, 0), batch]))
    assert [k for p in parts for k in p.column("k").to_pylist()] == 2 * list(range(100))
    assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100) for p in parts)

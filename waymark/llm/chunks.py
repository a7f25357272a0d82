"""Texts cut into chunks that a byte-level pre-tokenizer never joins; each distinct chunk is encoded once for a block.

No piece of the pre-tokenizer's pattern holds white space after another character, or a mark such as a comma after a
letter. So a text can be cut before a space or a line's end that follows a character that isn't white space, and between
a letter and a mark, and the chunks be encoded apart. Arrow splits the texts of a block and numbers the distinct chunks;
ids are then gathered by numpy. A chunk is remembered between blocks, within a number of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks are forgotten when they and their ids take about so many bytes.
MEMO_BYTES = 80_000_000
#: What an entry of a dict takes besides its strings.
ENTRY_BYTES = 200
#: Ids are gathered for so many chunks at a time.
GATHERED = 1_000_000
#: Stands before a chunk that doesn't begin with a space. Texts that hold it are cut one by one.
BARE = "\x01"
_MARK = r"(\pL)([.,;:!?])"
_CUT = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> list[str]:
    """The chunks of one text; together they are the text."""
    return _CUT.split(text)


class Memo:
    """What chunks are encoded to. encode: from distinct chunks to their ids as bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = MEMO_BYTES):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, chunks: Iterable[str]) -> None:
        """After this all of the chunks are known."""
        chunks = list(chunks)
        if self.size > self.limit:
            self.known.clear()
            self.size = 0
        new = list({c for c in chunks if c not in self.known})
        coded = self.encode(new)
        self.known.update(zip(new, coded, strict=True))
        self.size += sum(map(len, new)) + sum(map(len, coded)) + ENTRY_BYTES * len(new)


class Cut:
    """The texts of one Arrow array by chunks: keys are the distinct chunks, codes the chunks' places in keys."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        parted = pc.replace_substring(pc.replace_substring_regex(texts, _MARK, rf"\1 {BARE}\2"), "\n", f" {BARE}\n")
        found = pc.split_pattern(parted, " ")
        offsets = found.offsets.to_numpy().astype(np.int64)
        values = found.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self.bounds = offsets - offsets[0]
        distinct = values.dictionary
        self.codes = values.indices.to_numpy().astype(np.int32)
        first = self.bounds[:-1]  # the chunks that begin a text have no space before them
        led, own = np.unique(self.codes[first], return_inverse=True)
        bare = lambda x: pc.if_else(pc.starts_with(x, BARE), pc.utf8_slice_codeunits(x, 1), x)
        spaced = pc.if_else(pc.starts_with(distinct, BARE), pc.utf8_slice_codeunits(distinct, 1), pc.binary_join_element_wise(" ", distinct, ""))
        self.keys = spaced.to_pylist() + bare(distinct.take(pa.array(led))).to_pylist()
        # A chunk that is empty or ends in white space isn't apart from the next one; such texts are cut one by one.
        last = pc.utf8_slice_codeunits(distinct, -1)
        joined = pc.or_(pc.equal(pc.binary_length(last), 0), pc.utf8_is_space(last)).to_numpy(zero_copy_only=False)
        held = np.r_[0, np.cumsum(joined[self.codes])]
        odd = (held[self.bounds[1:]] > held[self.bounds[:-1]]) | pc.match_substring(texts, BARE).to_numpy(zero_copy_only=False)
        self.odd = {k: cut(texts[k].as_py()) for k in np.flatnonzero(odd).tolist()}
        self.codes[first] = len(distinct) + own
        if self.odd:  # the chunks found above aren't needed
            rows = np.repeat(~odd, np.diff(self.bounds))
            self.codes = self.codes[rows]
            self.bounds = np.r_[0, np.cumsum(np.where(odd, 0, np.diff(self.bounds)))]
            used = np.zeros(len(self.keys), dtype=bool)
            used[self.codes] = True
            self.codes = (np.cumsum(used) - 1)[self.codes].astype(np.int32)
            self.keys = [c for c, u in zip(self.keys, used.tolist(), strict=True) if u]

    def chunks(self) -> Iterable[str]:
        yield from self.keys
        for own in self.odd.values():
            yield from own

    def ids(self, known: dict[str, bytes], kind: np.dtype) -> list[bytes]:
        """The ids of each text, as bytes. known holds all of the chunks."""
        kind = np.dtype(kind)
        coded = [known[c] for c in self.keys]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // kind.itemsize
        flat = np.frombuffer(b"".join(coded), dtype=kind)
        starts = np.cumsum(sizes) - sizes
        out: list[bytes] = []
        while len(out) < len(self.bounds) - 1:
            k = len(out)
            to = max(k + 1, int(np.searchsorted(self.bounds, self.bounds[k] + GATHERED, side="right")) - 1)
            codes = self.codes[self.bounds[k] : self.bounds[to]]
            n = sizes[codes]
            ends = np.cumsum(n)
            at = np.repeat((starts[codes] - (ends - n)).astype(np.int32), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
            data = flat[at].tobytes()
            cuts = (np.r_[0, ends][self.bounds[k : to + 1] - self.bounds[k]] * kind.itemsize).tolist()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k, own in self.odd.items():
            out[k] = b"".join([known[c] for c in own])
        return out

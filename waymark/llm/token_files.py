"""Token ids as flat unsigned integer files with 64-bit document offsets, written and memory-mapped by Spark tasks.

Documents are dealt by ranges of doc_id (and, among equal ones, of how their texts begin), so that the files in order
hold the documents in ascending doc_id order. Each task writes one file set of about FILE_TEXT_BYTES of text; the tasks
return a row each, the token count, and the rows' prefix sums are the files' bases: 400,000 rows for 100 TB.

Format, for each partition k: ``k.ids`` (unsigned integers, little-endian, 16 bits if the vocabulary allows, else 32),
``k.offsets`` (n_docs + 1 64-bit offsets, in tokens from the file's start), ``k.docs`` (64-bit doc_ids) and ``k.nulls``
(a byte for each document, 1 where doc_id is null). ``bases`` holds, for each partition, its number and the tokens before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.chunks import Cut, Memo
from waymark.llm.common import map_rows, plain_documents, read_table, shared_dir, small_batches

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text for each file.
FILE_TEXT_BYTES = 256_000_000
#: Chunks in one call of the library.
LINE_CHUNKS = 1000
#: Texts are encoded in blocks of about so many bytes.
BLOCK_BYTES = 8_000_000
#: Rows of equal doc_id are dealt by so many first characters of their texts.
PREFIX_CHARS = 64
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, called once for each distinct chunk (see chunks).

    A text that holds an added token's string goes to the library as a whole, as all do under another pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        self.chunked = self.tokenizer.normalizer is None and kind is not None and "ByteLevel(add_prefix_space=False" in repr(kind)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: A byte-level token has a character for each of its bytes.
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())])
        self.memo = Memo(self._chunks)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks that begin with a space and don't end in one are put one after the other, many to a call; their tokens' bytes tell them apart."""
        apart = [c[:1] == " " and not c[-1:].isspace() for c in chunks]
        lined = [c for c, x in zip(chunks, apart, strict=True) if x]
        out: list[bytes] = []
        for lo in range(0, len(lined), LINE_CHUNKS):
            own = lined[lo : lo + LINE_CHUNKS]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, dtype=self.type)
            wanted = np.cumsum(np.fromiter(map(len, map(str.encode, own)), dtype=np.int64, count=len(own)))
            ends = np.cumsum(self.token_bytes[ids])
            cuts = np.searchsorted(ends, wanted)
            if cuts[-1] >= len(ends) or (ends[cuts] != wanted).any():  # some token has no plain bytes
                out += self._library(own)
                continue
            data, cuts = ids.tobytes(), ((cuts + 1) * self.type.itemsize).tolist()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        lined_ids, rest = iter(out), iter(self._library([c for c, x in zip(chunks, apart, strict=True) if not x]))
        return [next(lined_ids) if x else next(rest) for x in apart]

    def encode(self, texts: pa.Array) -> list[bytes]:
        whole = np.full(len(texts), not self.chunked)
        for t in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        parts = Cut(pc.if_else(pa.array(whole), "", texts))
        self.memo.learn(parts.chunks())
        out = parts.ids(self.memo.known, self.type)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._library([texts[k].as_py() or ""])[0]
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc ids, texts) of about BLOCK_BYTES."""
    own: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= BLOCK_BYTES:
            yield pa.concat_arrays([b.column("doc_id") for b in own]), pa.concat_arrays([b.column("text") for b in own])
            own, size = [], 0
    if own:
        yield pa.concat_arrays([b.column("doc_id") for b in own]), pa.concat_arrays([b.column("text") for b in own])


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, partitions: int = 8) -> list[tuple[int, int, int]]:
    """Write the files of docs below folder (a URI that all executors share); returns (partition, documents, first token).

    A file set's name is new for each attempt, so a task that is run again never meets the files of the one before;
    the sets that count are those named in what the tasks return.
    """
    token = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]):
        store, at = _store(folder)
        part, name = TaskContext.get().partitionId(), f"{token}-{TaskContext.get().taskAttemptId()}"
        coder, offset, n = encoder(tokenizer), 0, 0
        end = np.array([end_id], dtype=coder.type).tobytes()
        with (
            store.open_output_stream(f"{at}/{name}.ids") as ids_file,
            store.open_output_stream(f"{at}/{name}.offsets") as offsets_file,
            store.open_output_stream(f"{at}/{name}.docs") as docs_file,
            store.open_output_stream(f"{at}/{name}.nulls") as nulls_file,
        ):
            offsets_file.write(np.array([0], dtype="<u8").tobytes())

            for doc_ids, texts in in_blocks(batches):
                coded = coder.encode(texts)
                ends = offset + np.cumsum([len(x) // coder.type.itemsize + 1 for x in coded])
                ids_file.write(end.join([*coded, b""]))
                offsets_file.write(ends.astype("<u8").tobytes())
                docs_file.write(pc.fill_null(doc_ids, 0).to_numpy().astype("<i8").tobytes())
                nulls_file.write(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                offset, n = int(ends[-1]), n + len(texts)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([offset], pa.int64()), pa.array([coder.type.itemsize], pa.int32())], ["part", "name", "n", "tokens", "width"])

    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    rows = plain_documents(docs, "doc_id", "text", spread=False)
    ordered = rows.repartitionByRange(partitions, "doc_id", F.substring("text", 1, PREFIX_CHARS)).sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        found = sorted(map(tuple, map_rows(ordered, run, "part int, name string, n bigint, tokens bigint, width int").collect()))  # a row for each file
    bases = np.r_[0, np.cumsum([tokens for *_, tokens, _ in found])].tolist()
    sets = [(name, n, base, width) for (_, name, n, _, width), base in zip(found, bases, strict=False) if n]
    with store.open_output_stream(f"{at}/bases") as f:
        f.write("".join(f"{name} {n} {base} {width}\n" for name, n, base, width in sets).encode())
    kept = {name for name, *_ in sets} | {"bases"}
    for info in store.get_file_info(fs.FileSelector(at)):  # of attempts that failed or were run twice, and of tasks without rows
        if info.base_name.startswith(token) and info.base_name.rsplit(".", 1)[0] not in kept:
            store.delete_file(info.path)
    return sets


def _numbers(store: fs.FileSystem, path: str, kind: str, lo: int, hi: int) -> np.ndarray:
    """Numbers lo to hi of a file: memory-mapped where it's a local file, else read by range."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")[lo:hi] if hi > lo else np.empty(0, kind)
    size = np.dtype(kind).itemsize
    with store.open_input_file(path) as f:
        f.seek(lo * size)
        return np.frombuffer(f.read((hi - lo) * size), dtype=kind)


def read_token_files(spark: SparkSession, folder: str, sets: list[tuple[str, int, int, int]]) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens and the ids' checksum."""

    def run(batches):
        store, at = _store(folder)
        for batch in batches:
            for name, n, base, width in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "base", "width")), strict=True):
                for lo in range(0, n, 1024):
                    hi = min(lo + 1024, n)
                    offsets = _numbers(store, f"{at}/{name}.offsets", "<u8", lo, hi + 1).astype(np.int64)
                    doc_ids, nulls = _numbers(store, f"{at}/{name}.docs", "<i8", lo, hi), _numbers(store, f"{at}/{name}.nulls", "u1", lo, hi).astype(bool)
                    ids, own = _numbers(store, f"{at}/{name}.ids", f"<u{width}", int(offsets[0]), int(offsets[-1])), (offsets - offsets[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own, own[1:], strict=False)]
                    yield pa.record_batch([pa.array(doc_ids, mask=nulls), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(sets, "name string, n bigint, base bigint, width int").repartition(max(1, len(sets)))
    return map_rows(frame, run, SCHEMA)


def token_output(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write docs as token files and return one row per document as read back from them.

    Every row of docs gives a row. A null text counts as empty and has the end id alone. Rows with a null doc_id come
    first; rows of the same doc_id follow each other, by text. An empty table gives no rows. A very long text is encoded
    by chunks like others; one that holds an added token's string goes to the library whole. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if not urlparse(folder).scheme:
        folder = f"file://{os.path.abspath(folder)}"
    if partitions is None:  # by the size of the input's files
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE_TEXT_BYTES))
    sets = write_token_files(docs, folder, tokenizer or public_tokenizers.path(TOKENIZER_FILE), end_id, int(partitions))
    if not sets:
        return spark.createDataFrame([], SCHEMA)
    return read_token_files(spark, folder, sets)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_files": op6_token_files}
ORACLE_SQL: dict[str, str] = {}

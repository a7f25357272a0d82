"""Repeated strings across documents by blockwise suffix sorting with a difference cover.

A suffix matters by its first 50 bytes only, as strings of 50 bytes are what repeats. Let D be a difference cover modulo
21: for any two places i and j there is a shift below 21 that takes both of them to a place which is in D modulo 21. So if
the suffixes at i and j agree in 50 bytes, the cover's suffixes at that shift agree in 30.

1. Documents are packed into shards, written once. A copy of a whole document with a smaller doc_id goes at once; it has
   no string that the other lacks. Of the rest's cover suffixes, 5 in 21, each shard sends the distinct hashes
   of 30 bytes, by buckets of the hash. One bucket is sorted at a time; what comes back to a shard is a bit for each of
   its hashes: whether another shard ties with it. These are the cover's ranks, as far as they're needed.
2. A suffix without a tied cover suffix in reach is like no other and isn't sorted. The rest, the long ties, are dealt to
   buckets by a hash of their 50 bytes, and again one bucket is sorted at a time: a bit says whether a smaller doc_id has
   the string too.

A shard and a bucket share one row of sorted hashes, as differences; so the disk that's needed follows the text, at some
three bytes for each cover suffix, rather than 50 for each suffix. Buckets grow in number, not in size. Suffixes stand in
the order of their hashes, as only equal ones are looked for; hashes of the last step have twice as many bits as the
number of all bytes, and 12 on top, so the odds are below 1 in 8,000 that any two strings of a corpus share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import ship
from waymark.llm.common import co_located, in_slices, plain_documents, read_table, set_for, small_batches, written

#: Strings of so many bytes are removed where a smaller doc_id has them too.
WINDOW = 50
#: A difference cover: any two residues modulo MODULUS have a shift that takes both into COVER.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
PREFIX = WINDOW - MODULUS + 1
#: Bytes of text in a shard, unless one document has more, and hashes in a bucket.
SHARD_BYTES, BUCKET_HASHES = 4_000_000, 1_000_000
#: Places that are hashed at a time.
HASHED = 1 << 18
#: A null doc_id is smaller than none.
NO_ID = (1 << 63) - 1
SHARD_SCHEMA = "shard bigint, ids array<bigint>, sizes array<bigint>, digests array<binary>, n_bytes bigint, blob binary"
KEYS_SCHEMA = "bucket bigint, shard bigint, n bigint, keys binary, rest binary, owners binary"
BITS_SCHEMA = "shard bigint, bucket bigint, bits binary"
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_TIMES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def hashes(blob: np.ndarray, places: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """64-bit hashes of the length bytes from each place; blob has at least so many bytes after each."""
    words = np.ndarray((max(0, len(blob) - 7),), "<u8", blob, strides=(1,))  # the 8 bytes from each place
    steps = [*range(0, length - 8, 8), length - 8]
    out = np.empty(len(places), np.uint64)
    for lo in range(0, len(places), HASHED):
        at = places[lo : lo + HASHED]
        h = np.full(len(at), _ODD[kind])
        for s in steps:
            h = (h ^ words[at + s]) * _TIMES[kind]
            h ^= h >> np.uint64(29 + 3 * kind)
        h = h * _ODD[1 - kind]
        out[lo : lo + HASHED] = h ^ (h >> np.uint64(32))
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, so that those that hardly vary take no room."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _sorted(keys: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, then rest, and where in it a new pair of key and rest begins."""
    order = np.argsort(keys, kind="stable")
    k, r = keys[order], rest[order]
    new = np.r_[True, k[1:] != k[:-1]][: len(k)]
    if (r[1:] != r[:-1])[~new[1:]].any():  # keys that differ in the rest alone: hardly ever
        order = np.lexsort((rest, keys))
        k, r = keys[order], rest[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
    return order, new


def _covered(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some range holds."""
    return np.cumsum(np.bincount(begins, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0


class Shard:
    """Documents one after the other."""

    def __init__(self, row: dict):
        self.number = row["shard"]
        self.ids = np.array([NO_ID if x is None else x for x in row["ids"]], dtype=np.int64)
        self.nulls = [x is None for x in row["ids"]]
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.blob = np.frombuffer(zstandard.decompress(row["blob"]), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.copies = np.zeros(len(self.sizes), bool)
        self.copies[row["copies"] or []] = True

    def _owners(self, places: np.ndarray) -> np.ndarray:
        """The documents of places in ascending order."""
        return np.repeat(np.arange(len(self.sizes)), np.diff(np.r_[0, np.searchsorted(places, self.starts + self.sizes)]))

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover's suffixes that have PREFIX bytes, and the documents they're in."""
        found = []
        for d in np.flatnonzero((self.sizes >= WINDOW) & ~self.copies).tolist():
            own = np.arange(0, self.sizes[d] - PREFIX + 1, MODULUS)[:, None] + np.array(COVER)
            own = own.ravel()
            found.append(self.starts[d] + own[: np.searchsorted(own, self.sizes[d] - PREFIX, side="right")])
        places = np.concatenate(found) if found else np.empty(0, np.int64)
        return places, self._owners(places)

    def cover_keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, their keys' numbers, the distinct keys in order, and whether two documents of the shard share each."""
        places, owners = self.cover()
        distinct, number = np.unique(hashes(self.blob, places, PREFIX) >> np.uint64(64 - bits), return_inverse=True)
        least, most = np.full(len(distinct), len(self.sizes)), np.full(len(distinct), -1)
        np.minimum.at(least, number, owners)
        np.maximum.at(most, number, owners)
        return places, number, distinct, least != most

    def suffixes(self, bits: int, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes of WINDOW bytes that have a tied cover suffix in reach, and their documents. tied: a bit for each distinct key."""
        places, number, _, shared = self.cover_keys(bits)
        places = places[(tied | shared)[number]]
        at = np.flatnonzero(_covered(np.maximum(places - MODULUS + 1, self.starts[self._owners(places)]), places + 1, len(self.blob)))
        owners = self._owners(at)
        whole = at + WINDOW <= (self.starts + self.sizes)[owners]
        return at[whole], owners[whole]

    def suffix_keys(self, bits: int, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents, numbers of the keys; the distinct keys (two hashes) in order; the smallest doc_id of each."""
        at, owners = self.suffixes(bits, tied)
        high, low = hashes(self.blob, at, WINDOW), hashes(self.blob, at, WINDOW, 1)
        order, new = _sorted(high, low)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        least = np.full(len(first), NO_ID)
        np.minimum.at(least, number, self.ids[owners])
        return at, owners, number, high[first], low[first], least


def _bucket_bounds(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets: a power of two."""
    return np.r_[np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << np.uint64(bits - buckets.bit_length() + 1)), len(keys)]


def _dealt(shard: int, keys: np.ndarray, bits: int, buckets: int, rest: np.ndarray | None = None, owners: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    bounds = _bucket_bounds(keys, bits, buckets)
    full = np.flatnonzero(np.diff(bounds))
    rows = [[], [], [], [], [], []]
    for b in full.tolist():
        lo, hi = bounds[b], bounds[b + 1]
        parts = (b, shard, int(hi - lo), _packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), b"" if rest is None else _packed(rest[lo:hi]), b"" if owners is None else _packed(owners[lo:hi]))
        for column, x in zip(rows, parts, strict=True):
            column.append(x)
        if len(rows[0]) == 64:
            yield _keys_batch(rows)
            rows = [[], [], [], [], [], []]
    if rows[0]:
        yield _keys_batch(rows)


def _keys_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["bucket", "shard", "n", "keys", "rest", "owners"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket at a time, from rows sorted by bucket."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and own[0]["bucket"] != row["bucket"]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _bits_batch(rows: list[dict], bits: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum([r["n"] for r in rows])
    masks = [zstandard.compress(np.packbits(bits[e - r["n"] : e]).tobytes(), 1) for r, e in zip(rows, ends.tolist(), strict=True)]
    return pa.record_batch([pa.array([r["shard"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int64()), pa.array(masks, pa.binary())], ["shard", "bucket", "bits"])


def tied_in_bucket(rows: list[dict]) -> pa.RecordBatch:
    """For each key of each shard whether another shard has it."""
    keys = np.concatenate([np.cumsum(_unpacked(r["keys"], "<u8"), dtype=np.uint64) for r in rows])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    tied = np.zeros(len(keys), bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    return _bits_batch(rows, tied)


def smaller_in_bucket(rows: list[dict]) -> pa.RecordBatch:
    """For each string of each shard whether another shard has it under a smaller doc_id."""
    keys = np.concatenate([np.cumsum(_unpacked(r["keys"], "<u8"), dtype=np.uint64) for r in rows])
    kind = f"<u{len(zstandard.decompress(rows[0]['rest'])) // rows[0]['n']}"
    rest = np.concatenate([_unpacked(r["rest"], kind) for r in rows])
    ids = np.concatenate([_unpacked(r["owners"], "<i8") for r in rows])
    order, new = _sorted(keys, rest)
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = np.empty(len(keys), bool)
    smaller[order] = least[np.cumsum(new) - 1] < ids[order]
    return _bits_batch(rows, smaller)


def _spread(masks: list[dict] | None, keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The buckets' bits, for all of a shard's keys."""
    out, bounds = np.zeros(len(keys), bool), _bucket_bounds(keys, bits, buckets)
    for x in masks or ():
        lo, hi = bounds[x["bucket"]], bounds[x["bucket"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(zstandard.decompress(x["bits"]), np.uint8), count=int(hi - lo)).astype(bool)
    return out


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """Documents packed into shards, which a task numbers alike whenever it's run again."""

    def pack(batches: Iterator[pa.RecordBatch]):
        number, ids, sizes, digests, blob = TaskContext.get().partitionId() << 32, [], [], [], bytearray()

        def shard():
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.binary())), pa.array([len(blob)], pa.int64()), pa.array([zstandard.compress(bytes(blob), 1)], pa.binary())], ["shard", "ids", "sizes", "digests", "n_bytes", "blob"])

        for batch in in_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if ids and len(blob) + len(data) > shard_bytes:
                    yield shard()
                    number, ids, sizes, digests, blob = number + 1, [], [], [], bytearray()
                ids.append(doc_id)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).digest() if len(data) >= WINDOW else None)
                blob += data
        if ids:
            yield shard()

    ship.ensure(docs.sparkSession)
    return docs.mapInArrow(pack, SHARD_SCHEMA)


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _beside(shards: DataFrame, found: DataFrame, what: str, name: str) -> DataFrame:
    """Each shard with a list of what was found for it; shards are co-located, so only the list moves."""
    lists = found.groupBy("shard").agg(F.collect_list(F.expr(what)).alias(name))
    return shards.join(lists.hint("shuffle_hash"), "shard", "left")


def _copies(packed: DataFrame) -> DataFrame:
    """(shard, place) of the documents of which a smaller doc_id has the whole text. The first ids are written, so Spark can split the rows of a text with very many copies."""
    rows = packed.select("shard", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "d")).select("shard", "place", F.coalesce("d.ids", F.lit(NO_ID)).alias("doc_id"), "d.digests").filter("digests IS NOT NULL")
    firsts = written(rows.groupBy("digests").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    return rows.join(firsts, "digests").filter("first_id < doc_id").select("shard", "place")


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """For every row its bytes, how many are removed and in how many spans, and the digest of the rest.

    A byte goes if a string of 50 bytes holds it that also starts in a row of a smaller doc_id. Rows of one doc_id don't
    count against each other; a null doc_id is smaller than none, and larger than all others. Null and empty texts have
    no bytes, and texts below 50 bytes lose none. Every row of docs gives a row; an empty table gives none. A very long
    text is a shard by itself. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    plain = plain_documents(docs, "doc_id", "text")
    # As many buckets as Spark makes partitions, so that lists by shard are dealt alike.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark, 256), co_located(_shards(plain, shard_bytes), "shard", buckets, "shards") as stored, set_for(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        return _without_repeats(stored, bucket_hashes)


def _without_repeats(stored: DataFrame, bucket_hashes: int) -> DataFrame:
    spark = stored.sparkSession
    n_bytes = stored.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_cover = max(1, n_bytes * len(COVER) // MODULUS)
    bits, buckets = min(64, n_cover.bit_length() + 12), _power_of_two(-(-n_cover // bucket_hashes))
    tasks = max(spark.sparkContext.defaultParallelism, buckets)

    def each(fn, schema: str, df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from fn(batch.slice(k, 1).to_pylist()[0])

        return df.mapInArrow(run, schema)

    def sorted_buckets(df: DataFrame, fn) -> DataFrame:
        return df.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: (fn(rows) for rows in _buckets(batches)), BITS_SCHEMA)

    def cover_of(row: dict):
        shard = Shard(row)
        return _dealt(shard.number, shard.cover_keys(bits)[2], bits, buckets)

    shards = _beside(stored.drop("digests"), written(_copies(stored), "copies"), "place", "copies")
    tied = written(sorted_buckets(each(cover_of, KEYS_SCHEMA, shards), tied_in_bucket), "tied")

    def tied_keys(shard: Shard, row: dict) -> np.ndarray:
        return _spread(row["tied"], shard.cover_keys(bits)[2], bits, buckets)

    rest = 2 * n_bytes.bit_length() + 12 - 64
    low = next(k for k in (8, 16, 32, 64) if k >= rest)

    def suffixes_of(row: dict):
        shard = Shard(row)
        *_, high, other, least = shard.suffix_keys(bits, tied_keys(shard, row))
        return _dealt(shard.number, high, 64, buckets, (other >> np.uint64(64 - low)).astype(f"<u{low // 8}"), least)

    marked = _beside(shards, tied, "struct(bucket, bits)", "tied")
    smaller = written(sorted_buckets(each(suffixes_of, KEYS_SCHEMA, marked), smaller_in_bucket), "smaller")

    def removed_of(row: dict):
        shard = Shard(row)
        at, owners, number, high, _, least = shard.suffix_keys(bits, tied_keys(shard, row))
        repeats = _spread(row["smaller"], high, 64, buckets)[number] | (least[number] < shard.ids[owners])
        gone = _covered(at[repeats], at[repeats] + WINDOW, len(shard.blob))
        gone |= np.repeat(shard.copies, shard.sizes)
        begins = gone & ~np.r_[False, gone[:-1]]
        begins[shard.starts[shard.sizes > 0]] = gone[shard.starts[shard.sizes > 0]]
        lo, hi = shard.starts, shard.starts + shard.sizes
        n_gone, n_spans = (np.r_[0, np.cumsum(x)] for x in (gone, begins))
        kept = [hashlib.sha256((shard.blob[a:b] if whole else shard.blob[a:b][~gone[a:b]]).tobytes()).hexdigest() for a, b, whole in zip(lo.tolist(), hi.tolist(), (n_gone[hi] == n_gone[lo]).tolist(), strict=True)]
        yield pa.record_batch([pa.array(shard.ids, mask=np.array(shard.nulls)), pa.array(shard.sizes), pa.array(n_gone[hi] - n_gone[lo]), pa.array(n_spans[hi] - n_spans[lo]), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return written(each(removed_of, SCHEMA, _beside(marked, smaller, "struct(bucket, bits)", "smaller")), "kept")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLE_SQL = {
    "op13_suffix_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 2 * (512 + 49)) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 512)) AS c FROM docs WHERE n >= 50)),
windows AS (SELECT doc_id, c + i AS i, substr(part, 2 * i + 1, 100) AS w FROM (SELECT doc_id, c, part, unnest(range(least(512, n - 49 - c))) AS i FROM parts)),
firsts AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first_id < doc_id),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM steps) GROUP BY doc_id, s),
gaps AS (
    SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans
    UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(r.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN rest r USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
}

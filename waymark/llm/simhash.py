"""SimHash near duplicates by an inverted index of byte positions with count filtering.

Fingerprints that differ in at most 4 of 64 bits differ in at most 4 of 8 bytes, so at least 4 positional bytes are
shared. The lists of single positional bytes grow with the corpus and would give a quadratic number of pairs. So the
index intersects three lists at a time: 20 triples of positions are enough for every set of 4 positions to contain one
(Turan's covering of 4-sets by triples on 8 points), and each list is 2^16 times shorter. Within a list the positional
bytes that a pair shares are tallied; pairs with 4 or more are kept and verified by their bits. A list returns a
spanning forest of its links rather than all of them, so its output is no larger than the list. Lists that are long are
split by each further position before they are dealt to tasks; within a task, what is still long is split by its bits:
of any 5 groups of them, two fingerprints that differ in 4 bits share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import ship
from waymark.llm.common import map_rows, plain_documents, read_table, written
from waymark.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
#: Lists up to this length are compared by shifts, all lists of a batch at once; longer ones are split.
SHORT_LIST = 48
#: Lists beyond this length are split by each further positional byte before they are dealt out.
LONG_LIST = 4096
#: A table of so many long lists' keys is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Groups of near fingerprints that are taken out of a list before it's split, and how often it's split.
SEEDS, DEPTH = 16, 4
#: Shingle hashes are counted in runs of so many.
HASH_RUN = 65_536


def covering_triples(n: int = BYTES) -> list[tuple[int, ...]]:
    """Triples of positions such that every 4 positions contain one: three groups; all within a group, or two with one of the next."""
    groups = [range(0, 3), range(3, 6), range(6, n)]
    out = [t for g in groups for t in combinations(g, 3)]
    for g, following in zip(groups, groups[1:] + groups[:1], strict=True):
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in following]
    return out


def fingerprint(text: str | None) -> int:
    """64 bits: bit i is 1 if it's set in over half of the shingles' hashes; zero if there are no words."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z, and space with \t to \r
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][: len(words) - SHINGLE_WORDS + 1].tolist()
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), HASH_RUN):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + HASH_RUN], stops[at : at + HASH_RUN], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = plain_documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return map_rows(rows, run, "doc_id bigint, text_hash bigint, fp bigint")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes, and then differ in few enough bits."""
    x = a ^ b
    enough = (np.ascontiguousarray(x)[..., None].view(np.uint8) == 0).sum(axis=-1) >= BYTES - MAX_BITS
    enough[enough] = np.bitwise_count(x[enough]) <= MAX_BITS
    return enough


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows by links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def _absorbed(fps: np.ndarray, seed: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What links reach from a row among rows, and the rows that are left."""
    frontier, members = np.array([seed]), []
    while len(frontier) and len(rows):
        near = np.zeros(len(rows), dtype=bool)
        for at in range(0, len(frontier), 64):
            rest = np.flatnonzero(~near)
            near[rest] = _close(fps[frontier[at : at + 64], None], fps[rows[None, rest]]).any(axis=0)
        frontier, rows = rows[near], rows[~near]
        members.append(frontier)
    return np.concatenate(members) if members else rows[:0], rows


def _shifted(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of short lists, which stand in rows sorted by key."""
    a, b, at = [], [], np.arange(len(keys))
    for shift in range(1, SHORT_LIST):
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        near = at[_close(fps[at], fps[at + shift])]
        a.append(near)
        b.append(near + shift)
    return (np.concatenate(a), np.concatenate(b)) if a else (at[:0], at[:0])


def _split(fps: np.ndarray, rows: np.ndarray, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked in a long list. Dense groups are taken out first, since splits would keep them together."""
    seeds = 0
    while len(rows) > SHORT_LIST and (seeds < SEEDS or depth == DEPTH):
        k = len(rows) // 2
        seed, rest = rows[k], np.delete(rows, k)
        members, rows = _absorbed(fps, seed, rest)
        seeds += 1
        if len(members):
            yield members, np.full(len(members), seed)
    if len(rows) <= SHORT_LIST:
        a, b = _shifted(np.zeros(len(rows), dtype=np.int64), fps[rows])
        yield rows[a], rows[b]
        return
    own = fps[rows]
    varying = int(np.bitwise_or.reduce(own ^ own[0]))
    bits = [k for k in range(64) if varying >> k & 1]
    for group in np.array_split(bits, MAX_BITS + 1):
        keys = own & np.uint64(sum(1 << int(k) for k in group))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(bounds)
        short = np.repeat((sizes > 1) & (sizes <= SHORT_LIST), sizes)
        at = rows[order[short]]
        a, b = _shifted(keys[short], fps[at])
        yield at[a], at[b]
        for k in np.flatnonzero(sizes > SHORT_LIST).tolist():
            yield from _split(fps, rows[order[bounds[k] : bounds[k + 1]]], depth + 1)


def links_of_lists(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the lists in rows sorted by key, from each row to the first of its group in the list.

    fps: unsigned 64-bit integers, distinct in a list.
    """
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_LIST), sizes))
    a, b = _shifted(keys[short], fps[short])
    links = [(short[a], short[b])]
    for k in np.flatnonzero(sizes > SHORT_LIST).tolist():
        links += _split(fps, np.arange(bounds[k], bounds[k + 1]))
    root = _roots(len(keys), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return fps[moved], fps[root[moved]]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole lists, several at a time, from rows sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        keys, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if len(keys) and size >= 50_000 and keys[-1] != held[0][0][0]:  # a list ends in this batch
            cut = int(np.searchsorted(keys, keys[-1]))
            held.append((keys[:cut], fps[:cut]))
            yield np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            held, size, keys, fps = [], 0, keys[cut:], fps[cut:]
        if len(keys):
            held.append((keys, fps))
            size += len(keys)
    if held:
        yield np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])


def near_links(nodes: DataFrame) -> DataFrame:
    """(u, v) of distinct fingerprints fp; they connect exactly what links of at most 4 differing bits connect."""

    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255).cast("bigint"))
    triples = covering_triples()

    def positional(triple: tuple[int, ...], k: int):
        key = F.lit(k).cast("bigint")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        return key

    def run(batches: Iterator[pa.RecordBatch]):
        for keys, fps in _lists(batches):
            u, v = links_of_lists(keys, np.ascontiguousarray(fps).view(np.uint64))
            if len(u):
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    keyed = nodes.select("fp", F.explode(F.array(*(positional(t, k) for k, t in enumerate(triples)))).alias("key"))
    long = written(keyed.groupBy("key").count().filter(F.col("count") > LONG_LIST).select("key"), "long")
    if n := long.count():  # their rows go to the lists of each set of four positions that holds the triple
        long = long.withColumn("is_long", F.lit(True))
        marked = keyed.join(F.broadcast(long) if n <= BROADCAST_KEYS else long, "key", "left")
        triple = F.shiftright("key", 24).cast("int")
        taken = F.element_at(F.array(*(F.lit(sum(1 << p for p in t)) for t in triples)), triple + 1)
        longer = F.array(*(F.struct(F.lit(p).alias("p"), F.shiftleft(triple.cast("bigint") * 8 + p + 64, 32).bitwiseOR(F.shiftleft(F.col("key").bitwiseAND(0xFFFFFF), 8)).bitwiseOR(byte(p)).alias("key")) for p in range(BYTES)))
        four = F.transform(F.filter(longer, lambda x: taken.bitwiseAND(F.pow(F.lit(2), x["p"]).cast("int")) == 0), lambda x: x["key"])
        keyed = marked.select("fp", F.explode(F.when(F.col("is_long"), four).otherwise(F.array("key"))).alias("key"))
    ship.ensure(nodes.sparkSession)
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, group_fp and text_hash of every row.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts have no words
    and so the fingerprint zero, which links like any other. Repeated rows each give a row. A null doc_id is never the
    smallest; a component without any other has a null component_id. An empty table gives no rows. Exact copies are one
    node, however many; rows with a fingerprint that very many share are joined by Spark's skew join. A very long text's
    shingles are hashed in runs. group_fp is the component's own key: the smallest fingerprint, as a signed integer.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    near = written(near_links(nodes), "near")
    stars = components(near)
    grouped = nodes.join(stars, nodes.fp == stars.u, "left").select("fp", "first_id", F.coalesce("v", "fp").alias("group_fp"))
    firsts = grouped.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(firsts, "group_fp").select("fp", "group_fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_fp", "text_hash")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id stays (of rows with one doc_id, the one with the smallest text hash).

    Null, empty and blank texts are one group, and what is near them. A null doc_id stays only in a group without any
    other. Of equal rows one stays. An empty table stays empty. All columns are kept, whatever their names.
    """
    found = near_duplicates(docs)
    best = found.groupBy("group_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best"))
    keys = ["__waymark_no_id", "__waymark_id", "__waymark_hash"]  # none is null, so join and deduplication share one exchange

    def keyed(doc_id, text_hash):
        return dict(zip(keys, (doc_id.isNull(), F.coalesce(doc_id.cast("bigint"), F.lit(0)), text_hash), strict=True))

    kept = best.select(*(x.alias(k) for k, x in keyed(F.col("best.doc_id"), F.col("best.text_hash")).items()))
    marked = docs.withColumns(keyed(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))))
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}

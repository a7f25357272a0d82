"""Vector clustering, periodic runs and repeated strings against brute force, on odd tables, ties, repeats and long texts."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import periodic_runs, suffix_dedup, vector_clusters

SF = "/root/testdata/sf0.001"
SHA = lambda b: hashlib.sha256(b).hexdigest()

# --- 11 -------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    vectors = np.array([np.clip(np.floor(256 * np.array(v, dtype=float)), -(1 << 27), 1 << 27) for _, v in kept]).astype(np.int64).astype(object).reshape(-1, 64)
    order = sorted((j for j, (i, _) in enumerate(kept) if i is not None), key=lambda j: (hashlib.sha256(f"2:{kept[j][0]}".encode()).hexdigest(), vectors[j].astype(np.int64).astype("<i4").tobytes()))
    centroids = [vectors[j].copy() for j in order[:k]]
    for step in range(rounds + 1):
        distances = np.array([[int(((v - c) ** 2).sum()) for c in centroids] for v in vectors], dtype=object)
        nearest = [min(range(len(centroids)), key=lambda c: (d[c], c)) for d in distances]
        if step < rounds:
            for c in range(len(centroids)):
                own = [v for v, n in zip(vectors, nearest, strict=True) if n == c]
                if own:
                    centroids[c] = np.array([sum(col) // len(own) for col in zip(*own, strict=True)], dtype=object)
    sums = {}
    for d, n in zip(distances, nearest, strict=True):
        sums[n] = sums.get(n, 0) + d[n]
    return sorted((i is None, i or 0, n, d[n], sums[n], sum(sums.values()), SHA(",".join(map(str, centroids[n])).encode())) for (i, _), d, n in zip(kept, distances, nearest, strict=True))


def clustered(df, *args, **kwargs):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in vector_clusters.cluster_vectors(df, *args, **kwargs).collect())


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, rid string"


def odd_vectors(seed=3, n=120):
    rng = np.random.default_rng(seed)
    own = rng.normal(0, 0.3, (n, 64)).astype(np.float32).tolist()
    rows = [(i, v, 1, "x", None) for i, v in enumerate(own)]
    rows += [(500 + i, own[i], 1, "x", None) for i in range(10)]  # copies
    rows += [(7, own[7], 1, None, "y"), (7, own[8], None, None, "y"), (None, own[9], 1, None, None)]  # repeated rows and ids, a null id
    rows += [(900, None, 1, None, None), (901, own[0][:63], 1, None, None), (902, [*own[0], 1.0], 1, None, None), (903, [None, *own[0][1:]], 1, None, None), (904, [float("nan"), *own[0][1:]], 1, None, None), (905, [float("-inf"), *own[0][1:]], 1, None, None), (906, [], 1, None, None)]
    rows += [(950, [1e30] * 64, 1, None, None), (951, [-3e6, 5e5, *own[1][2:]], 1, None, None)]  # beyond what is kept apart
    return rows


@pytest.mark.parametrize("k", [1, 7, 400])
def test_clusters_are_the_plain_ones(spark, k):
    rows = odd_vectors()
    got = clustered(spark.createDataFrame(rows, VECTORS).repartition(3), k, 3)
    assert got == plain_clusters([r[:2] for r in rows], k, 3)


def test_clusters_of_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 2)] * 64, 0, "", "") for i in range(20)] + [(100, [0.5] * 64, 0, "", "")]
    df = spark.createDataFrame(rows, VECTORS)
    assert clustered(df, 6, 2) == plain_clusters([r[:2] for r in rows], 6, 2)
    same = spark.createDataFrame([(i, [0.25] * 64, 0, "", "") for i in range(9)], VECTORS)
    assert {r[2] for r in clustered(same, 4, 2)} == {0}
    assert vector_clusters.cluster_vectors(df.limit(0)).collect() == []
    assert vector_clusters.cluster_vectors(df.filter("vec_id < 0")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_spare_vectors(spark):
    """No centroid that a cell excludes is the nearest; on vectors in groups most aren't fetched after the first round."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (8, 64))
    v = np.floor(centres[rng.integers(0, 8, 2000)] + rng.normal(0, 12, (2000, 64))).astype(np.int64)
    grid = vector_clusters.Cells(v.min(axis=0), v.max(axis=0), v.mean(axis=0), v.std(axis=0))
    cells = grid.approximate(v)
    assert cells.shape == (2000, 48)
    unpacked = grid.unpacked(cells)
    at = np.arange(64)
    assert (grid.low[at, unpacked] <= v).all() and (v <= grid.high[at, unpacked]).all()
    c = np.floor(centres + rng.normal(0, 5, centres.shape)).astype(np.int64)
    may = vector_clusters.Bounds(grid, c).possible(cells)
    nearest = vector_clusters.squared_distances(v, c).argmin(axis=1)
    assert may[np.arange(2000), nearest].all() and may.sum(axis=1).mean() < 1.1
    report = []
    df = spark.createDataFrame([(i, (x / 256 + 1e-4).tolist(), 0, "", "") for i, x in enumerate(v)], VECTORS)
    vector_clusters.cluster_vectors(df, 8, 3, report)
    assert report[0] == (2000, 2000) and all(fetched < 700 for fetched, _ in report[1:])


# --- 12 -------------------------------------------------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            if words[x] != words[x + q]:
                x += 1
                continue
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            if y + q - x >= max(6, 4 * q):
                found.setdefault((x, y + q), q)
            x = y
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text, altered=True):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if altered and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *first, None if first[0] is None else 1000 * first[1] // first[2], SHA("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()), SHA(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def by_rows(rows):
    return sorted(map(tuple, rows), key=str)


def test_runs_are_the_plain_ones(spark, documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        for altered in (True, False):
            want = [plain_row(r.doc_id, r.text, altered) for r in docs.collect()]
            assert by_rows(periodic_runs.find_runs(docs, altered).collect()) == by_rows(want)
    assert sum(r[1] > 0 for r in (plain_row(r.doc_id, r.text) for r in documents.collect())) > 5
    assert periodic_runs.find_runs(no_docs).collect() == []


def test_runs_of_random_words_however_appended():
    rng = np.random.default_rng(15)
    for _ in range(600):
        n, kinds = int(rng.integers(0, 130)), int(rng.integers(1, 5))
        words = rng.integers(0, kinds, n)
        for _ in range(int(rng.integers(0, 4))):
            if n > 8:
                a = int(rng.integers(0, n))
                p = int(rng.integers(1, max(2, (n - a) // 3)))
                stop = min(n, a + p * int(rng.integers(2, 9)))
                words[a:stop] = words[a + (np.arange(stop - a) % p)]
        want = plain_runs(words.tolist())
        for most in (n + 1, 1, 7):
            catcher, at = periodic_runs.SquareCatcher(), 0
            while at < n:
                to = at + int(rng.integers(1, most + 1))
                catcher.append(words[at:to])
                at = to
            assert catcher.runs() == want, words.tolist()


def test_runs_of_long_streams():
    """Ten megabytes of one word, of a long period and of none: in time with their length."""
    for words, want in ((np.zeros(2_000_000, int), [(0, 2_000_000, 1)]), (np.arange(2_000_000) % 333_333, [(0, 2_000_000, 333_333)]), (np.arange(2_000_000), [])):
        catcher = periodic_runs.SquareCatcher()
        for at in range(0, len(words), periodic_runs.APPENDED):
            catcher.append(words[at : at + periodic_runs.APPENDED])
        assert catcher.runs() == want


# --- 13 -------------------------------------------------------------------------------------------------------


def plain_repeats(rows):
    first = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(i, first.get(w, i))
    out = []
    for (doc_id, _), (i, t) in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, SHA(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return by_rows(out)


def removed(df, **kwargs):
    return by_rows((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **kwargs).collect())


DOCS = "doc_id bigint, text string, shard string, bucket string, n_bytes string"


def test_the_cover_covers():
    d = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.MODULUS for a in d for b in d} == set(range(suffix_dedup.MODULUS))


def test_repeats_of_odd_documents(spark, odd_docs, no_docs):
    assert removed(odd_docs) == plain_repeats([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert removed(no_docs) == []


@pytest.mark.parametrize("shard_bytes", [300, 4_000_000])
def test_repeats_at_every_offset_and_length(spark, shard_bytes):
    """Passages of 45 to 75 bytes at all residues, copies, near copies, bytes beyond ASCII, one id twice, null ids; whatever the shards."""
    rng = np.random.default_rng(16)
    letters = list("abcdefghij \né")
    word = lambda n: "".join(rng.choice(letters, n))
    passages = [word(int(n)) for n in rng.integers(45, 76, 12)]
    texts = [word(int(rng.integers(0, 60))) + passages[int(rng.integers(0, 12))] + word(int(rng.integers(0, 60))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4][:-1], texts[5] + "!", "", word(49), passages[0], passages[0][:50]]
    ids = rng.permutation(len(texts)).tolist()
    ids[0], ids[10], ids[11] = ids[1], None, None
    rows = [(i, t, "s", "b", "n") for i, t in zip(ids, texts, strict=True)]
    want = plain_repeats([r[:2] for r in rows])
    assert sum(r[2] for r in want) > 500
    assert removed(spark.createDataFrame(rows, DOCS).repartition(4), shard_bytes=shard_bytes, bucket_hashes=500) == want


def test_repeats_of_a_long_text(spark):
    """Ten megabytes in one document, of which others have parts."""
    rng = np.random.default_rng(17)
    long = "".join(map(chr, rng.integers(97, 123, 10_000_000)))
    rows = [(5, long), (2, long[1_000_000:1_000_049]), (3, long[2_000_000:2_000_050]), (4, "x" * 60 + long[5_000_000:5_100_000]), (9, long[7_000_000:7_000_200])]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame([(*r, "", "", "") for r in rows], DOCS)).collect()}
    assert {k: (r.n_removed, r.n_spans) for k, r in got.items()} == {2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (100_050, 2), 9: (200, 1)}
    assert got[5].kept_sha256 == SHA((long[:2_000_000] + long[2_000_050:5_000_000] + long[5_100_000:]).encode())


def test_common_passages_and_copies(spark):
    """One text a third of all rows, near copies of it, and one line in all."""
    line = "the very same line stands in every document of this table, word for word"
    rows = [(i, ("one common text, copied over and over again; " * 3 if i % 3 == 0 else f"document {i} " * 12) + line, "", "", "") for i in range(150)]
    assert removed(spark.createDataFrame(rows, DOCS), shard_bytes=2000, bucket_hashes=200) == plain_repeats([r[:2] for r in rows])


def test_new_queries_run_over_whole_tables(spark):
    for query, table in ((vector_clusters.op11_vector_clusters, "embeddings"), (periodic_runs.op12_periodic_runs, "documents"), (suffix_dedup.op13_suffix_dedup, "documents")):
        assert query(spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").filter(F.lit(True)).count()

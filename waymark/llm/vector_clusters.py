"""Centroid clustering with a vector approximation file.

Each vector is approximated by a cell of 6 bits for each component, cut at quantiles of a normal distribution with the
component's mean and deviation; 48 bytes in place of 256. What a centroid's squared distance exceeds the vector's own
square by, the sum of c (c - 2 x), is linear in x, so a cell gives it bounds, by a look-up in a table for each component:
the own square is the same for all centroids and needn't be bounded. A round reads the approximations only. Where these
intervals overlap, those of the differences to the most likely centroid are looked up, which are narrower as what two
centroids have in common drops out. Where they overlap still, the full vector is fetched, by a join, and only the
centroids that remain are measured. Sums change by what has moved: a vector that keeps its cluster isn't fetched for them.
The last step fetches all, as the result holds distances.

Components are integers and all sums exact, so the result doesn't depend on the partitions. Approximations and their
assignments are one written table a round; vectors are dealt to buckets once and stay there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import co_located, map_rows, read_table, written

DIMENSIONS, CENTROIDS, ROUNDS = 64, 40, 5
#: Components are floor(SCALE * x). Beyond LARGEST they are taken as LARGEST, as squared distances have 64 bits.
SCALE, LARGEST = 256, 1 << 27
#: Bits of a component's cell.
BITS = 6
#: Starting centroids are those of the smallest sha256 of this and the vec_id.
SEED = "2:"
#: Squared sums below this are exact in floating point.
EXACT = 1 << 53
SCHEMA = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, DIMENSIONS).astype(np.int64)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, as integers; of large components one centroid at a time."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * DIMENSIONS * int(largest) ** 2 < EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Cells:
    """The approximation's grid: for each component the cells' ends, as integers that both belong to them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray):
        normal = NormalDist()
        cuts = np.array([normal.inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])
        inner = np.floor(mean[:, None] + deviation[:, None] * cuts)
        self.cuts = np.clip(inner, low[:, None], high[:, None]).astype(np.int64)  # a cell begins at its cut
        self.low = np.concatenate([low[:, None], self.cuts], axis=1)
        self.high = np.concatenate([np.maximum(self.cuts - 1, low[:, None]), high[:, None]], axis=1)

    def approximate(self, vectors: np.ndarray) -> np.ndarray:
        """Packed cells, a row of bytes for each vector."""
        cells = np.stack([np.searchsorted(self.cuts[d], vectors[:, d], side="right") for d in range(vectors.shape[1])], axis=1).astype(np.uint8)
        return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(cells), -1), axis=1)

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1, count=len(self.cuts) * BITS).reshape(len(packed), -1, BITS)
        return (bits * (1 << np.arange(BITS)[::-1]).astype(np.uint8)).sum(axis=2, dtype=np.uint8)

    def tables(self, centroids: np.ndarray, reference: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest values by component, cell and centroid of the squared distance, less that to the reference (without one: to the origin)."""
        r = np.zeros(centroids.shape[1], np.int64) if reference is None else reference
        square, slope = (centroids**2 - r**2).T[:, None, :], 2 * (centroids - r).T[:, None, :]
        a, b = square - slope * self.low[:, :, None], square - slope * self.high[:, :, None]
        return np.minimum(a, b), np.maximum(a, b)


class Bounds:
    """Which centroids may be the nearest of approximated vectors."""

    def __init__(self, grid: Cells, centroids: np.ndarray):
        self.grid, self.centroids = grid, centroids
        self.least, self.most = grid.tables(centroids)
        self.by_reference: dict[int, np.ndarray] = {}

    def _looked_up(self, table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return sum(table[d][cells[:, d]] for d in range(cells.shape[1]))

    def possible(self, packed: np.ndarray) -> np.ndarray:
        """Those whose least distance isn't above another's greatest one."""
        cells = self.grid.unpacked(packed)
        least, most = self._looked_up(self.least, cells), self._looked_up(self.most, cells)
        may = least <= most.min(axis=1)[:, None]
        open_ones = np.flatnonzero(may.sum(axis=1) > 1)
        likely = np.where(may, least + most, np.iinfo(np.int64).max).argmin(axis=1)
        for r in np.unique(likely[open_ones]).tolist():
            if r not in self.by_reference:
                self.by_reference[r] = self.grid.tables(self.centroids, self.centroids[r])[0]
            own = open_ones[likely[open_ones] == r]
            may[own] &= self._looked_up(self.by_reference[r], cells[own]) <= 0
        return may


def _grid(vectors: DataFrame) -> Cells:
    """The components' extent, mean and deviation over all vectors: one row for each task, then 64."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, low, high, total, squares = 0, np.full(DIMENSIONS, LARGEST), np.full(DIMENSIONS, -LARGEST), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        for batch in batches:
            v = _vectors(batch.column("vec"))
            n, low, high = n + len(v), np.minimum(low, v.min(axis=0, initial=LARGEST)), np.maximum(high, v.max(axis=0, initial=-LARGEST))
            total, squares = total + v.sum(axis=0), squares + (v.astype(np.float64) ** 2).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(range(DIMENSIONS), pa.int32()), pa.array([n] * DIMENSIONS, pa.int64()), *map(pa.array, (low, high, total, squares))], ["d", "n", "low", "high", "total", "squares"])

    parts = map_rows(vectors.select("vec"), run, "d int, n bigint, low bigint, high bigint, total double, squares double")
    rows = sorted(parts.groupBy("d").agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("total"), F.sum("squares")).collect())
    _, n, low, high, total, squares = (np.array(x, dtype=np.float64) for x in zip(*rows, strict=True))
    mean = total / n
    return Cells(low.astype(np.int64), high.astype(np.int64), mean, np.sqrt(np.maximum(squares / n - mean**2, 0)))


def _first_centroids(vectors: DataFrame, n: int) -> np.ndarray:
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256))
    rows = hashed.filter("vec_id IS NOT NULL").orderBy("h", "vec").limit(n).select("vec").collect()  # n rows, from the tasks' own first n
    return np.array([np.frombuffer(r.vec, dtype="<i4") for r in rows], dtype=np.int64).reshape(-1, DIMENSIONS)


def _bounded(state: DataFrame, grid: Cells, centroids: np.ndarray) -> DataFrame:
    """state with each vector's new cluster, -1 where bounds overlap, and the centroids that are possible, as bits of bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        bounds = Bounds(grid, centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            may = bounds.possible(np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            new = np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1).astype(np.int32)
            bits = [row.tobytes() for row in np.packbits(may, axis=1)]
            yield pa.record_batch([*(batch.column(c) for c in ("rid", "cells", "cluster")), pa.array(new), pa.array(bits, pa.binary())], ["rid", "cells", "cluster", "new", "may"])

    return map_rows(state, run, "rid bigint, cells binary, cluster int, new int, may binary")


def _measured(vectors: np.ndarray, may: list[bytes], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each vector's possible centroids, of equal ones the first, and its distance."""
    allowed = np.unpackbits(np.frombuffer(b"".join(may), np.uint8).reshape(len(vectors), -1), axis=1, count=len(centroids)).astype(bool)
    distances = np.where(allowed, squared_distances(vectors, centroids), np.iinfo(np.int64).max)
    nearest = distances.argmin(axis=1)
    return nearest.astype(np.int32), distances[np.arange(len(vectors)), nearest]


def _settled(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The new state of fetched vectors, and after each task's rows what they change in the clusters' sums and counts."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]):
        sums, counts = np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64)
        names = ["rid", "cells", "cluster", "n", "sums"]
        for batch in batches:
            if not batch.num_rows:
                continue
            v, old = _vectors(batch.column("vec")), batch.column("cluster").to_numpy()
            new, _ = _measured(v, batch.column("may").to_pylist(), centroids)
            moved = new != old
            for at, sign in ((new, 1), (old, -1)):
                own = moved & (at >= 0)
                np.add.at(sums, at[own], sign * v[own])
                np.add.at(counts, at[own], sign)
            yield pa.record_batch([batch.column("rid"), batch.column("cells"), pa.array(new), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.list_(pa.int64()))], names)
        yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], names)

    return map_rows(fetched, run, "rid bigint, cells binary, cluster int, n bigint, sums array<bigint>")


def _last(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                cluster, distance = _measured(_vectors(batch.column("vec")), batch.column("may").to_pylist(), centroids)
                yield pa.record_batch([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return map_rows(fetched, run, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(embeddings: DataFrame, n_centroids: int = CENTROIDS, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """Each kept vector's cluster after the rounds, its squared distance, the clusters' and all vectors' sums, and the centroid's digest.

    Rows are kept whose embedding has 64 components, none null, NaN or infinite. Repeated rows, and rows of one vec_id,
    each give a row; of starting centroids with one vec_id the smaller vector comes first. A null vec_id is clustered but
    never starts a centroid. With fewer kept vectors than centroids there are as many centroids; without any, no rows.
    Equally near centroids: the smaller number. Components beyond 2^19 count as 2^19. Only vec_id and embedding are read.
    report gets, for each round, how many vectors were fetched of how many.
    """
    spark = embeddings.sparkSession
    wide = embeddings.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("embedding"))
    fine = wide.filter((F.size("embedding") == DIMENSIONS) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))

    def integers(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            v = np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype("<i4")
            yield pa.record_batch([batch.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "vec"])

    vectors = written(map_rows(fine, integers, "vec_id bigint, vec binary").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    centroids = _first_centroids(vectors, n_centroids)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    grid = _grid(vectors)

    def approximated(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                cells = [r.tobytes() for r in grid.approximate(_vectors(batch.column("vec")))]
                yield pa.record_batch([batch.column("rid"), pa.array(cells, pa.binary()), pa.array([-1] * len(cells), pa.int32())], ["rid", "cells", "cluster"])

    state = written(map_rows(vectors.select("rid", "vec"), approximated, "rid bigint, cells binary, cluster int"), "cells")
    sums, counts = [[0] * DIMENSIONS for _ in centroids], [0] * len(centroids)
    with co_located(vectors, "rid", vectors.rdd.getNumPartitions(), "vectors") as stored:
        for _ in range(rounds):
            bounded = written(_bounded(state, grid, centroids), "bounds")
            settled = written(_settled(bounded.filter("new = -1 OR new != cluster").join(stored.select("rid", "vec"), "rid"), centroids), "settled")
            if report is not None:
                report.append((settled.filter("rid IS NOT NULL").count(), bounded.count()))
            changes = settled.filter("rid IS NULL").select("cluster", "n", F.posexplode("sums").alias("d", "x"))
            for c, d, n, x in changes.groupBy("cluster", "d").agg(F.sum("n"), F.sum(F.col("x").cast("decimal(38,0)"))).collect():  # 64 rows a centroid
                sums[c][d] += int(x)
                counts[c] += n if d == 0 else 0
            centroids = np.array([[x // n for x in own] if n else old for own, n, old in zip(sums, counts, centroids.tolist(), strict=True)], dtype=np.int64)
            state = bounded.filter("new >= 0 AND new = cluster").select("rid", "cells", "cluster").unionByName(settled.filter("rid IS NOT NULL").select("rid", "cells", "cluster"))
        bounded = written(_bounded(state, grid, centroids), "bounds")
        rows = written(_last(bounded.select("rid", "may").join(stored, "rid"), centroids), "clusters")
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    total = sum(int(r.s) for r in by_cluster)
    told = spark.createDataFrame([(r.cluster, int(r.s), total, sha[r.cluster]) for r in by_cluster], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds unrolled. near and moved: each vector's nearest centroid, and the centroids after a round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('{SEED}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT {CENTROIDS}))""",
    ]
    near = "near{r} AS MATERIALIZED (SELECT rid, vec_id, v, min(d) AS distance, min_by(k, (d, k)) AS k FROM (SELECT rid, vec_id, v, k, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS BIGINT) AS d FROM kept, c{r}) GROUP BY rid, vec_id, v)"
    moved = """c{s} AS MATERIALIZED (SELECT k, CASE WHEN m IS NULL THEN c ELSE m END AS c FROM c{r} LEFT JOIN (
    SELECT k, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY d) AS m FROM (SELECT k, d, sum(v[d]) AS t, count(*) AS n FROM (SELECT k, v, unnest(range(1, {dims} + 1)) AS d FROM near{r}) GROUP BY k, d) GROUP BY k) USING (k))"""
    for r in range(ROUNDS):
        parts += [near.format(r=r), moved.format(r=r, s=r + 1, dims=DIMENSIONS)]
    parts.append(near.format(r=ROUNDS))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN c{ROUNDS} USING (k)"""


QUERIES = {"op11_vector_clusters": op11_vector_clusters}
ORACLE_SQL = {"op11_vector_clusters": _oracle()}

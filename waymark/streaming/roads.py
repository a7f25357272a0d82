"""A road cache that follows moving devices: a versioned table, changed between micro-batches.

Each version is a micro-batch's: what it added, in folders of its own, that it overwrites if it runs again. Readers take a
version and see all up to it, so a query keeps one snapshot while the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, bounding_box, to_east, to_north

WAYS = "way_id bigint, name string, highway string, points array<struct<lat:double,lon:double>>"
CENTRES = "lat double, lon double"
#: Width of the grid's cells, in degrees, in which ways and boxes meet.
CELL_DEG = 0.01


def _band(lat: Column, metres: float) -> Column:
    return F.floor(F.radians(lat) * EARTH_RADIUS_M / metres)


def _column(lon: Column, band: Column, metres: float) -> Column:
    """The cell within a band, whose cells are as wide in metres at the band's middle."""
    middle = (band + 0.5) * metres / EARTH_RADIUS_M
    return F.floor(F.radians(lon) * EARTH_RADIUS_M * F.cos(middle) / metres)


def uncovered(positions: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """Positions (lat, lon) that lie at least so many metres from every centre. Both meet in cells of that size and their neighbours."""
    band = _band(F.col("lat"), metres)
    held = centres.select(F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), _band(F.col("lat"), metres).alias("_band"))
    held = held.withColumn("_col", _column(F.col("_clon"), F.col("_band"), metres))
    # Two cells to either side: a position's cell in a neighbouring band is shifted by the bands' different widths.
    probes = positions.withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
    cell = _column(F.col("lon"), F.col("_band"), metres)
    probes = probes.withColumn("_col", F.explode(F.sequence(cell - 2, cell + 2)))
    east, north = to_east(F.col("_clat"), F.col("_clon"), F.col("lon")), to_north(F.col("_clat"), F.col("lat"))
    near = probes.join(held, ["_band", "_col"]).filter(F.sqrt(east * east + north * north) < metres).select("lat", "lon").distinct()
    return positions.join(near, ["lat", "lon"], "left_anti")


def ways_around(centres: DataFrame, ways: DataFrame, radius_m: float) -> DataFrame:
    """(lat, lon of the centre, way_id) of ways whose box meets the centre's box of that radius."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL_DEG), F.floor(hi / CELL_DEG)))
    boxes = centres.select("lat", "lon", *(v.alias(k) for k, v in bounding_box(F.col("lat"), F.col("lon"), F.lit(radius_m)).items()))
    boxes = boxes.withColumn("_cy", cells(F.col("south"), F.col("north"))).withColumn("_cx", cells(F.col("west"), F.col("east")))
    lats, lons = F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"])
    own = ways.filter(F.size("points") > 0).select("way_id", F.array_min(lats).alias("_s"), F.array_max(lats).alias("_n"), F.array_min(lons).alias("_w"), F.array_max(lons).alias("_e"))
    own = own.withColumn("_cy", cells(F.col("_s"), F.col("_n"))).withColumn("_cx", cells(F.col("_w"), F.col("_e")))
    return boxes.join(own, ["_cx", "_cy"]).filter("_s <= north AND _n >= south AND _w <= east AND _e >= west").select("lat", "lon", "way_id").distinct()


class RoadCache:
    """Ways near where devices have been, in a folder that all executors share.

    A device that is at least `share` of the radius from every cached centre makes its position a centre, for which the
    source's ways within the radius are taken over, if their id isn't there yet. A centre without any way isn't cached, so
    it is asked for again.
    """

    def __init__(self, spark: SparkSession, folder: str, radius_m: float = 300.0, share: float = 0.6):
        self.spark, self.folder, self.radius_m, self.share = spark, folder.rstrip("/"), radius_m, share

    def versions(self) -> list[int]:
        """Of the micro-batches that added something, whole ones only: their centres are written last."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/centres")
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        found = [s.getPath() for s in store.listStatus(top) if s.getPath().getName().startswith("version=")]
        return sorted(int(p.getName().partition("=")[2]) for p in found if store.exists(p.suffix("/_SUCCESS")))

    def _read(self, what: str, schema: str, version: int | None) -> DataFrame:
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{what}/version={v}" for v in known))

    def ways(self, version: int | None = None) -> DataFrame:
        """All ways up to a version, or the newest; (way_id, name, highway, points)."""
        return self._read("ways", WAYS, version)

    def centres(self, version: int | None = None) -> DataFrame:
        return self._read("centres", CENTRES, version)

    def refresh(self, positions: DataFrame, source: DataFrame, batch: int) -> None:
        """Adds what the devices' last positions (device, ts_ns, lat, lon) of a micro-batch ask for, as version `batch`.

        It starts from the versions before, so a batch that runs again writes the same rows to the same place. Null
        positions don't count.
        """
        last = positions.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("device").agg(F.max(F.struct("ts_ns", "lat", "lon")).alias("p")).select("p.lat", "p.lon").distinct()
        asked = uncovered(last, self.centres(batch - 1), self.share * self.radius_m).persist()
        try:
            if asked.isEmpty():
                return
            met = ways_around(asked, source, self.radius_m).persist()
            if met.isEmpty():
                return
            new = source.join(met.select("way_id").distinct(), "way_id", "left_semi").join(self.ways(batch - 1).select("way_id"), "way_id", "left_anti")
            new.select("way_id", "name", "highway", "points").dropDuplicates(["way_id"]).write.mode("overwrite").parquet(f"{self.folder}/ways/version={batch}")
            met.select("lat", "lon").distinct().write.mode("overwrite").parquet(f"{self.folder}/centres/version={batch}")
            met.unpersist()
        finally:
            asked.unpersist()

    def follow(self, stream: DataFrame, source: Callable[[], DataFrame], checkpoint: str):
        """Starts a query that refreshes the cache with every micro-batch of a stream of positions; source is read anew each time."""
        return stream.writeStream.foreachBatch(lambda df, batch: self.refresh(df, source(), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

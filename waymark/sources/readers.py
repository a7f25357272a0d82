"""Sources of sessions, sensors, tracks and roads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.sources.schema import canonical_name, require, typed, with_canonical_names


def session_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw session files in latin-1: session_id (the file's name), row_idx (its place in the file) and canonical columns.

    The order of a file's rows is data, as its clock may be reset; a file is read by one task, so the ids grow along it.
    Rows that can't be parsed hold nulls.
    """
    raw = spark.read.options(header=True, encoding="ISO-8859-1", multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    rows = with_canonical_names(raw).withColumns({"source_file": F.input_file_name(), "_id": F.monotonically_increasing_id()})
    rows = rows.withColumn("session_id", F.regexp_extract("source_file", r"([^/]+?)(?:\.csv)?$", 1))
    return typed(rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("session_id").orderBy("_id")).cast("bigint") - 1).drop("_id"))


def session_csv_checked(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """session_csv of files that are to have these columns, without the rows that don't fit, and a report of every file of the folder.

    The report has source_file, n_bytes, n_rows (that fit), n_bad and an outcome: "read", "bad rows" (some fit, some don't),
    "unreadable" (none fits: another format, a broken archive, an empty file). A file that can't be read to its end gives
    the rows before that; no file fails the scan. The files' names come from a listing, so those that give no row are there.
    """
    options = {"header": True, "encoding": "ISO-8859-1", "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    named = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the sources write a path's begin in two ways
    names = spark.createDataFrame([(f,) for f in spark.read.format("binaryFile").load(path).inputFiles()], "source_file string").select(named("source_file").alias("source_file"))
    sizes = spark.read.format("binaryFile").load(path).select(named("path").alias("source_file"), F.col("length").alias("n_bytes"))  # no content is read
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt_record"]])
    raw = spark.read.options(**options, mode="PERMISSIVE", ignoreCorruptFiles=True, enforceSchema=True).schema(schema).csv(path)
    rows = raw.withColumns({"source_file": named(F.col("_metadata.file_path")), "_id": F.monotonically_increasing_id()})
    bad = F.col("_corrupt_record").isNotNull()
    # Spark parses only the columns that a query needs, and can't tell a bad row by fewer: this needs them all.
    parsed = F.xxhash64(*(F.col(f"`{c}`") for c in columns)) % 2 < 2
    counts = rows.groupBy("source_file").agg(F.count_if(~bad & parsed).alias("n_rows"), F.count_if(bad & parsed).alias("n_bad"))
    report = names.join(sizes, "source_file", "left").join(counts, "source_file", "left").na.fill(0, ["n_bytes", "n_rows", "n_bad"])
    report = report.withColumn("outcome", F.when(F.col("n_rows") == 0, "unreadable").when(F.col("n_bad") > 0, "bad rows").otherwise("read"))
    good = rows.filter(~bad).drop("_corrupt_record")
    good = good.toDF(*(c if c in ("source_file", "_id") else canonical_name(c) for c in good.columns))
    good = good.withColumn("session_id", F.regexp_extract("source_file", r"([^/]+?)(?:\.csv)?$", 1))
    order = Window.partitionBy("session_id").orderBy("_id")
    return typed(good.withColumn("row_idx", F.row_number().over(order).cast("bigint") - 1).drop("_id")), report


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(header=True, encoding="ISO-8859-1").csv(path).columns


def trip_csv(spark: SparkSession, path: str) -> DataFrame:
    """session_csv with t_sec from the first row's time."""
    w = Window.partitionBy("session_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return session_csv(spark, path).withColumn("t_sec", (F.col("time_ms") - F.first("time_ms").over(w)) / 1000)


def sessions(spark: SparkSession, path: str, prefix: str = "S-V", skip: Sequence[str] = ()) -> DataFrame:
    """Processed sessions; the filters on session_id prune partitions."""
    rows = spark.read.parquet(path).filter(F.col("session_id").startswith(prefix))
    return rows.filter(~F.col("session_id").isin(*skip)) if skip else rows


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points: t (epoch seconds), lat, lon, speed, in time order."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("_lat", T.DoubleType()), ("_lon", T.DoubleType()), ("ele", T.DoubleType()), ("time", T.StringType()), ("speed", T.DoubleType()), ("sat", T.IntegerType()))])
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    return rows.select(F.unix_micros(F.to_timestamp("time")).alias("us"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", "speed", "sat").withColumn("t", F.col("us") / 1e6).orderBy("us")


def sensor_csv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A sensor logger's file: t in seconds from epoch nanoseconds, and prefix_x, _y, _z."""
    raw = spark.read.options(header=True).schema("time bigint, x double, y double, z double").option("enforceSchema", False).csv(path)
    return raw.select((F.col("time") / 1e9).alias("t"), *(F.col(a).alias(f"{prefix}_{a}") for a in "xyz"))


def edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files of the edge contract's twelve columns, checked, in file order; a file is a session and read by one task."""
    raw = require(spark.read.options(header=True, inferSchema=True, multiLine=True).csv(path))
    rows = raw.withColumns({"_id": F.monotonically_increasing_id(), "session_id": F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1)})
    return rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("session_id").orderBy("_id")).cast("bigint") - 1).drop("_id")


_POINT = "struct<lat:double,lon:double>"
OSM = f"elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,geometry:array<{_POINT}>>>"


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OSM).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def osm_ways(elements: DataFrame) -> DataFrame:
    """(way_id, name, highway, points) of ways that carry their geometry."""
    own = elements.filter("type = 'way' AND geometry IS NOT NULL")
    return own.select(F.col("id").alias("way_id"), F.col("tags")["name"].alias("name"), F.col("tags")["highway"].alias("highway"), F.col("geometry").alias("points"))


def road_label(name: str = "name", highway: str = "highway", way_id: str = "way_id"):
    kind = F.col(highway)
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.when(kind.isNotNull(), F.concat(F.initcap(kind), F.lit(" Road"))), F.concat(F.lit("Road #"), F.col(way_id).cast("string")))


def write_sessions(df: DataFrame, path: str) -> None:
    """One folder for each session: readers of one session read no other."""
    df.repartition("session_id").sortWithinPartitions("session_id", "row_idx").write.mode("overwrite").partitionBy("session_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; built and written there if it isn't there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

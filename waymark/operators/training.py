"""Training tables: features of windows and segments with their targets, and ridge folds from one pass over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import wrap_two_pi
from waymark.operators.features import SIGNALS_56, SIGNALS_58, fix_segments, segment_displacement, stats_of, with_magnitudes
from waymark.operators.joins import range_join
from waymark.operators.windows import ordered

#: Of the velocity table, as fixed values: least speed at a fix, and least way from the fix before for a course.
LEAST_SPEED, LEAST_WAY_M = 0.5, 5.0


def features_at_fixes(samples: DataFrame, fixes: DataFrame, rows: int = 21, by: str = "session_id", order: str = "row_idx") -> DataFrame:
    """fixes with the 56 statistics of the `rows` samples that end with each; fixes with fewer are dropped.

    Only samples that a fix needs are touched: fixes and samples meet in buckets of `rows` row numbers, of which a window
    meets two at most, and Spark merges the statistics of both parts. So a session may hold any share of all rows.
    """
    bucket = lambda c: F.floor(c / rows)
    own = samples.select(by, order, *(c for c in samples.columns if c in SIGNALS_56))
    own = with_magnitudes(own).withColumn("_bucket", bucket(F.col(order)))
    ends = fixes.filter(F.col(order) >= rows - 1).select(by, F.col(order).alias("_end"))
    ends = ends.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("_end") - (rows - 1)), bucket(F.col("_end"))))))
    met = own.join(ends, [by, "_bucket"]).filter((F.col(order) <= F.col("_end")) & (F.col(order) > F.col("_end") - rows))
    found = met.groupBy(by, F.col("_end").alias(order)).agg(F.count("*").alias("_n"), *(x.alias(name) for s in SIGNALS_56 for name, x in stats_of(s).items()))
    return fixes.join(found.filter(F.col("_n") == rows).drop("_n"), [by, order])


def velocity_table(samples: DataFrame, flag: str, time: str, speed: str, east: str, north: str, rows: int = 21, by: str = "session_id", order: str = "row_idx") -> DataFrame:
    """A row for each fix that moves and has enough samples before it: the 56 features, y_vel, y_course, t_fix_s.

    y_course is the course from the fix before, whatever its speed, in [0, 2 pi); null within 5 m of it and for a first fix.
    """
    w = ordered(by, order)
    fixes = samples.filter(F.col(flag)).select(by, order, F.col(time).alias("t_fix_s"), F.col(speed).alias("y_vel"), (F.col(east) - F.lag(east).over(w)).alias("_de"), (F.col(north) - F.lag(north).over(w)).alias("_dn"))
    far = F.sqrt(F.col("_de") * F.col("_de") + F.col("_dn") * F.col("_dn")) > LEAST_WAY_M
    fixes = fixes.withColumn("y_course", F.when(far, wrap_two_pi(F.atan2("_de", "_dn")))).filter(F.col("y_vel") >= LEAST_SPEED).drop("_de", "_dn")
    return features_at_fixes(samples, fixes, rows, by, order)


def segment_table(samples: DataFrame, flag: str, time: str, speed: str, by: str = "session_id", order: str = "row_idx", most_s: float = 30.0, still: float = 0.5, bucket: int = 128) -> DataFrame:
    """A row for each pair of consecutive fixes that counts: the 58 features over its samples, both fixes included, and the targets.

    target_a is the speed at its end, target_b the speed's change, target_c what the way between the fixes exceeds the
    integrated one by. samples: east, north and heading (at fixes) besides the signals. Segments meet their samples by
    buckets of row numbers; a fix is in both segments that it bounds.
    """
    segments = fix_segments(samples, flag, time, speed, by, order, most_s, still)
    keys = [by, "seg_start"]
    spans = segments.select(*keys, "seg_end", (F.col("seg_start") - 1).alias("_low"))
    rows = range_join(with_magnitudes(samples).drop("heading"), spans, by, order, "_low", "seg_end", bucket)
    stats = rows.groupBy(*keys).agg(*(x.alias(name) for s in SIGNALS_58 for name, x in stats_of(s).items()))
    ways = segment_displacement(rows.filter(F.col(order) > F.col("seg_start")), segments, "acc_veh_fwd", "gyro_veh_yaw_rate", "dt", by, order)
    found = segments.join(stats, keys).join(ways, keys)
    return found.withColumns(
        {"seg_dur_s": F.col("dur_s"), "seg_n_samples": F.col("seg_end") - F.col("seg_start") + 1, "target_a": F.col("v_k1"), "target_b": F.col("v_k1") - F.col("v_k"), "target_c": F.col("ds_gnss") - F.col("ds_imu")}
    ).drop("east", "north", "heading")


# --- ridge folds ----------------------------------------------------------------------------------------------


def moment_sums(rows: DataFrame, folds: Sequence[str], trip: str, features: Sequence[str], label: str, limits: dict[str, float]) -> DataFrame:
    """(part, i, x), the upper halves of the sums of products of (1, features, label) over all rows (''), over each fold's own, and ('!' + fold) over those of
    the others whose label is beyond the fold's limit. Tasks send a matrix for each; Spark adds them up in one exchange."""
    names, width = list(features), len(features) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(dtype=float), batch["_y"].to_numpy(dtype=float)])
            trips = batch["_trip"].astype(str)
            parts = {"": np.ones(len(batch), bool)}
            for f in folds:
                own = trips.str.startswith(f).to_numpy(dtype=bool)
                parts[f] = own
                if f in limits:
                    parts[f"!{f}"] = ~own & (np.abs(z[:, -1]) >= limits[f])
            for part, own in parts.items():
                if own.any():
                    sums[part] = sums.get(part, np.zeros((width, width))) + z[own].T @ z[own]
        upper = np.triu_indices(width)
        yield pd.DataFrame({"part": list(sums), "sums": [m[upper] for m in sums.values()]})

    flat = rows.select(F.col(trip).cast("string").alias("_trip"), F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in names)).dropna()
    parts = flat.mapInPandas(run, "part string, sums array<double>").select("part", F.posexplode("sums").alias("i", "x"))
    return parts.groupBy("part", "i").agg(F.sum("x").alias("x"))


def _matrices(sums: DataFrame, width: int) -> dict[str, np.ndarray]:
    rows, upper, out = sums.collect(), np.triu_indices(width), {}  # half the square of the features for each fold
    for r in rows:
        out.setdefault(r.part, np.zeros((width, width)))[upper[0][r.i], upper[1][r.i]] = r.x
    return {part: m + np.triu(m, 1).T for part, m in out.items()}


def _solved(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of ridge with penalty alpha on features standardised by these rows' own moments; constant ones get 0."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0.0))
    live = scale > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))
    scale = np.where(live, scale, 1.0)
    gram = cov[:-1, :-1] / np.outer(scale, scale)
    weights = np.zeros(len(scale))
    weights[live] = np.linalg.solve(gram[np.ix_(live, live)] + alpha * np.eye(int(live.sum())), (cov[:-1, -1] / scale)[live])
    weights /= scale
    return float(mean[-1] - weights @ mean[:-1]), weights


def ridge_folds(rows: DataFrame, folds: Sequence[str], trip: str, features: Sequence[str], label: str, alpha: float = 1.0, clip_sigma: float | None = None) -> dict[str, tuple[float, np.ndarray]]:
    """(intercept, weights) of ridge for each fold, trained on the rows of no trip that begins with its name: one scan for all.

    The matrices of products are sums, so a fold's training matrix is the total less its own. clip_sigma: a fold's
    training rows whose label reaches that many deviations of theirs are taken off too; a scan of the labels comes first.
    Rows with a null in any column don't count; a fold that leaves no training rows isn't in the result.
    """
    limits: dict[str, float] = {}
    if clip_sigma:
        ok = rows.select(F.col(trip).cast("string").alias("_trip"), F.col(label).cast("double").alias("_y"), *features).dropna()
        spreads = ok.agg(*(F.stddev_pop(F.when(~F.col("_trip").startswith(f), F.col("_y"))).alias(f"s{k}") for k, f in enumerate(folds))).first()
        limits = {f: clip_sigma * s for f, s in zip(folds, spreads, strict=True) if s}
    sums = _matrices(moment_sums(rows, folds, trip, features, label, limits), len(features) + 2)
    found = {}
    for f in folds:
        m = sums.get("", np.zeros((len(features) + 2,) * 2)) - sums.get(f, 0.0) - sums.get(f"!{f}", 0.0)
        if m[0, 0] >= 1:
            found[f] = _solved(m, alpha)
    return found


def ridge_reports(rows: DataFrame, models: dict[str, tuple[float, np.ndarray]], trip: str, features: Sequence[str], label: str) -> DataFrame:
    """n_test, RMSE, MAE and median error of each fold's model on the fold's own rows: one scan, predictions as expressions."""
    ok = rows.select(F.col(trip).cast("string").alias("_trip"), F.col(label).cast("double").alias("_y"), *features).dropna()
    x = F.array(*(F.col(c).cast("double") for c in features))

    def guess(intercept: float, weights: np.ndarray):
        products = F.zip_with(x, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b)
        return F.lit(intercept) + F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    errors = F.array(*(F.when(F.col("_trip").startswith(f), F.struct(F.lit(f).alias("fold"), (guess(*m) - F.col("_y")).alias("e"))) for f, m in models.items()))
    e = ok.select(F.explode(F.array_compact(errors)).alias("z")).select("z.fold", "z.e")
    return e.groupBy("fold").agg(F.count("*").alias("n_test"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.median(F.abs("e")).alias("median_ae"))

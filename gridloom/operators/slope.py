"""Slopes of each series: Theil-Sen, ordinary least squares, Siegel's repeated median; intervals and fits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import series as S
from gridloom.functions.dist import normal_quantile, t_quantile
from gridloom.functions.kernels import kendall_scores, pair_ranks, repeated_medians, sen_slopes, with_statistics
from gridloom.functions.validate import choice, max_pairs as check_pairs
from gridloom.operators.grid import Stack, when_ok
from gridloom.operators.spatial import focal_median

METHODS = ("TS", "OLS", "RM")


def sampled_pairs(n: int, most: float, seed: int = 1) -> list[tuple[int, int]] | None:
    """None for all pairs; else ``most`` of them, drawn without replacement from a stateless hash. The same for all cells."""
    if math.comb(n, 2) <= check_pairs(most):
        return None
    from xxhash import xxh64_intdigest

    ranked = sorted((xxh64_intdigest(f"{seed}-{i}-{j}".encode()), i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1))
    return sorted((i, j) for _, i, j in ranked[: int(most)])


def theil_sen(y: Column, t: Column, pairs: list[tuple[int, int]] | None = None) -> Column:
    if pairs is None:
        return S.theil_sen(y, t)
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs))
    slopes = F.transform(table, lambda p: (F.element_at(y, p["j"]) - F.element_at(y, p["i"])) / (F.element_at(t, p["j"]) - F.element_at(t, p["i"])))
    return S.let(F.array_sort(slopes), S.sorted_median)


def slope_estimator(stack: Stack, method: str = "TS", max_pairs: float = math.inf, seed: int = 1, smooth_neighbourhood: bool = False) -> DataFrame:
    """grid_id, cell, row, col, ok, slope; with smoothing also slope_smooth, the median of the 3 x 3 window.

    ``max_pairs`` bounds the pairs of a Theil-Sen slope by a fixed sample; by default all pairs count.
    """
    choice(method, METHODS, "method")
    n, y, t = stack.spec.n_time, F.col("y"), stack.spec.t()
    if n < {"TS": 2, "OLS": 3, "RM": 3}[method]:
        raise ValueError(f"{method} needs more layers")
    pairs = sampled_pairs(n, max_pairs, seed) if method == "TS" else None
    if method != "OLS" and pairs is None:
        times = np.array(stack.spec.times)
        kernel = {"TS": lambda v: (sen_slopes(v, times),), "RM": lambda v: (repeated_medians(v, times),)}[method]
        rows = with_statistics(stack.cells.select("grid_id", "cell", "row", "col", "ok", "y"), ("slope",), kernel).drop("y")
        return focal_median(rows.withColumn("slope_smooth", F.col("slope")), "slope_smooth", stack.spec) if smooth_neighbourhood else rows
    value = theil_sen(y, t, pairs) if method == "TS" else S.ols(y, t)["slope"]
    rows = stack.cells.select("grid_id", "cell", "row", "col", "ok", when_ok(value).alias("slope"))
    if smooth_neighbourhood:
        rows = focal_median(rows.withColumn("slope_smooth", F.col("slope")), "slope_smooth", stack.spec)
    return rows


def theil_sen_long(long: DataFrame) -> DataFrame:
    """Theil-Sen slope from long rows (grid_id, cell, t_value, value), for axes that differ by cell; pairs of equal times do not count.

    Each cell's points meet once, in order of time; their pairs are compared or selected in numpy and are no rows. Null without a pair.
    """
    points = long.where(F.col("t_value").isNotNull() & F.col("value").isNotNull()).groupBy("grid_id", "cell")
    points = points.agg(F.sort_array(F.collect_list(F.struct(F.col("t_value").cast("double").alias("t"), F.col("value").cast("double").alias("y")))).alias("s"))

    def of(t: np.ndarray, y: np.ndarray) -> float:
        if len(t) > 1 and (np.diff(t) > 0).all():
            return float(sen_slopes(y[None, :], t)[0])
        i, j = np.triu_indices(len(t), 1)  # repeated times
        some = t[j] > t[i]
        return float(np.median((y[j] - y[i])[some] / (t[j] - t[i])[some])) if some.any() else np.nan

    def run(batches):
        for b in batches:
            times, values = (b.column(c) for c in ("t", "y"))
            ends = np.asarray(times.offsets)
            t, y = np.asarray(times.values), np.asarray(values.values)
            out = np.array([of(t[lo:hi], y[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64(), mask=np.isnan(out))], names=["grid_id", "cell", "slope"])

    kinds = dict(points.dtypes)
    return points.select("grid_id", "cell", F.col("s.t").alias("t"), F.col("s.y").alias("y")).mapInArrow(run, f"grid_id {kinds['grid_id']}, cell {kinds['cell']}, slope double")


# ------------------------------------------------------------------ fits of single series


def sen_interval(y: np.ndarray, t: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of each row: order statistics of the pair slopes around their median, with tie-corrected variance."""
    n = len(t) * (len(t) - 1) // 2
    half = normal_quantile(0.5 + level / 2) * np.sqrt(kendall_scores(y, True)[1])
    low, high = np.maximum(np.rint((n - half) / 2), 1), np.minimum(np.rint((n + half) / 2) + 1, n)
    ends = pair_ranks(y, t, np.stack([low, high], 1).astype(np.int64) - 1)
    return ends[:, 0], ends[:, 1]


def fit_series(stack: Stack, method: str = "TS", level: float = 0.95) -> DataFrame:
    """grid_id, cell, slope, intercept, lower, upper for each complete series (no interval for RM)."""
    choice(method, METHODS, "method")
    n, y, t = stack.spec.n_time, F.col("y"), stack.spec.t()
    rows = stack.cells.where("ok").select("grid_id", "cell", "ok", "y")
    if method == "OLS":
        z = t_quantile(0.5 + level / 2, n - 2)
        rows = rows.withColumn("f", S.ols(y, t)).select("grid_id", "cell", "f.*")
        return rows.select("grid_id", "cell", "slope", "intercept", (F.col("slope") - z * F.col("se")).alias("lower"), (F.col("slope") + z * F.col("se")).alias("upper"))
    times = np.array(stack.spec.times)

    def sen(v: np.ndarray) -> tuple[np.ndarray, ...]:
        slope = sen_slopes(v, times)
        return slope, np.median(v - slope[:, None] * times, axis=1) if len(v) else slope, *sen_interval(v, times, level)

    def siegel(v: np.ndarray) -> tuple[np.ndarray, ...]:
        return repeated_medians(v, times), repeated_medians(v, times, intercepts=True)

    names = ("slope", "intercept", "lower", "upper")
    found = with_statistics(rows, names, sen) if method == "TS" else with_statistics(rows, names[:2], siegel)
    none = F.lit(None).cast("double")
    return found.select("grid_id", "cell", "slope", "intercept", *(F.col(c) if method == "TS" else none.alias(c) for c in names[2:]))


def fit_all(stack: Stack, level: float = 0.95) -> DataFrame:
    """fit_series of every method, with the column ``method``."""
    out = None
    for m in METHODS:
        rows = fit_series(stack, m, level).withColumn("method", F.lit(m))
        out = rows if out is None else out.unionByName(rows)
    return out


def residual_autocorrelation(long: DataFrame) -> DataFrame:
    """Pearson correlation of a series with itself one step before, per grid_id and cell; null for constant series.

    long has grid_id, cell, t, value.
    """
    by = Window.partitionBy("grid_id", "cell").orderBy("t")
    pairs = long.withColumn("before", F.lag("value").over(by)).where(F.col("before").isNotNull())
    sums = pairs.groupBy("grid_id", "cell").agg(F.covar_samp("value", "before").alias("c"), F.stddev_samp("value").alias("s"), F.stddev_samp("before").alias("s0"))
    return sums.select("grid_id", "cell", F.when((F.col("s") > 0) & (F.col("s0") > 0), F.col("c") / (F.col("s") * F.col("s0"))).alias("r"))

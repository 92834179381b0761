"""Prewhitening of each series: four trend-free variants and their diagnostics.

The iterative variants stop for all cells of a grid at the same step, when no cell's correlation still
moves. One Arrow pass over the series computes gate and path of each cell and is checkpointed with them; a small
aggregate per step finds where each grid stops; a second pass whitens every cell by its value at that step. No series is
shuffled and no driver loop runs per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import series as S
from gridloom.functions.dist import Z_975
from gridloom.functions.kernels import matrix, sen_slopes, with_statistics
from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice, positive_integer, positive_number
from gridloom.operators.grid import Stack, require_valid, when_ok, with_series
from gridloom.operators.spatial import one_row_side

METHODS = ("TFPW_Y", "TFPW_WS", "TFPW_Z", "VCTFPW")
DIAGNOSTICS = {
    "TFPW_Y": ("Beta_TheilSen", "Rho"),
    "TFPW_WS": ("DW_initial", "Rho", "Modified", "Clamped"),
    "TFPW_Z": ("Rho", "Modified", "Clamped"),
    "VCTFPW": ("Rho", "Beta_corrected", "Modified"),
}
COLUMNS = ("grid_id", "cell", "row", "col", "ok")
LIMIT = 0.99

# Savin and White (1977), bounds of the Durbin-Watson statistic for one regressor at 5 percent.
DW_SIZES = (
    15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40,
    45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 100,
)
DW_LOWER = (
    1.077, 1.106, 1.133, 1.158, 1.180, 1.201, 1.221, 1.240, 1.257, 1.273, 1.288, 1.302, 1.316, 1.328, 1.341, 1.352, 1.363, 1.373, 1.383, 1.393, 1.402, 1.411, 1.419, 1.427, 1.435, 1.442,
    1.475, 1.503, 1.527, 1.549, 1.567, 1.583, 1.598, 1.611, 1.624, 1.635, 1.645, 1.654,
)
DW_UPPER = (
    1.361, 1.371, 1.381, 1.392, 1.401, 1.411, 1.420, 1.429, 1.437, 1.446, 1.454, 1.461, 1.468, 1.476, 1.483, 1.489, 1.496, 1.502, 1.508, 1.514, 1.519, 1.524, 1.530, 1.535, 1.540, 1.544,
    1.566, 1.585, 1.601, 1.616, 1.629, 1.641, 1.652, 1.662, 1.671, 1.679, 1.687, 1.694,
)


def dw_critical_values(n: int) -> tuple[float, float]:
    """(dL, dU) for n observations: linear between the tabulated sizes, the end values outside."""
    return float(np.interp(n, DW_SIZES, DW_LOWER)), float(np.interp(n, DW_SIZES, DW_UPPER))


def durbin_watson(stack: Stack) -> DataFrame:
    """cells with dw and rho1 of the straight-line residuals."""
    rows = stack.cells.withColumn("__d", when_ok(S.durbin_watson(F.col("y"), stack.spec.t())))
    return rows.select("grid_id", "cell", "row", "col", "y", "ok", F.inline_outer(F.array("__d")))


def prewhiten(
    stack: Stack, method: str = "TFPW_WS", gate: str = "threshold", dw_low: float = 1.4, dw_high: float = 2.6, dw_mode: str = "conservative",
    refit_method: str = "OLS", itmax: int = 20, eps: float = 1e-4,
) -> tuple[Stack, DataFrame]:
    """(the prewhitened stack, diagnostics: grid_id, cell, row, col, ok and DIAGNOSTICS[method])."""
    choice(method, METHODS, "method")
    require_valid(stack)
    if method != "TFPW_WS" and method != "TFPW_Z" and stack.spec.n_time < 4:
        raise ValueError(f"{method} needs four layers or more")
    if method == "TFPW_Y":
        return trend_free(stack)
    if method == "VCTFPW":
        return variance_corrected(stack)
    choice(gate, ("threshold", "test"), "gate")
    choice(dw_mode, ("conservative", "power"), "dw_mode")
    choice(refit_method, ("OLS", "TS"), "refit_method")
    return iterative(stack, method, gate, dw_low, dw_high, dw_mode, refit_method, positive_integer(itmax, "itmax"), positive_number(eps, "eps"))


def _kernel(stack: Stack, rows: DataFrame, run, schema: str) -> DataFrame:
    kind = dict(stack.cells.dtypes)["grid_id"]
    return rows.mapInArrow(run, f"grid_id {kind}, cell long, {schema}")


def _lists(a: np.ndarray) -> pa.Array:
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(a.ravel(), from_pandas=True))


def lag_one(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(1, keepdims=True)
    d = (c * c).sum(1)
    return np.divide((c[:, 1:] * c[:, :-1]).sum(1), d, out=np.zeros(len(x)), where=d > 0)


def trend_free(stack: Stack) -> tuple[Stack, DataFrame]:
    """Yue and Pilon: detrend by Theil-Sen, filter the first-order correlation of the rest, put the trend back; one layer less."""
    t, n = np.array(stack.spec.times), stack.spec.n_time - 1

    def run(batches):
        for b in batches:
            y = matrix(b.column(2)) if b.num_rows else np.zeros((0, n + 1))
            beta = sen_slopes(y, t)
            rest = y - beta[:, None] * t
            c = rest - rest.mean(1, keepdims=True)
            some = (c * c).sum(1) > 0
            rho = np.clip(lag_one(rest), -LIMIT, LIMIT)
            new = np.where(some[:, None], rest[:, 1:] - rho[:, None] * rest[:, :-1] + beta[:, None] * t[1:], np.nan)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(new), pa.array(beta), pa.array(rho, mask=~some)], names=["grid_id", "cell", "y", *DIAGNOSTICS["TFPW_Y"]])

    got = _kernel(stack, stack.cells.where("ok").select("grid_id", "cell", "y"), run, "y array<double>, Beta_TheilSen double, Rho double")
    return _joined(stack, got, DIAGNOSTICS["TFPW_Y"], n)


def variance_corrected_rows(y: np.ndarray, t: np.ndarray):
    n = y.shape[1]
    beta = sen_slopes(y, t)
    rest = y - beta[:, None] * (t - t[0])
    rho = lag_one(rest)
    change = np.abs(rho) > Z_975 / np.sqrt(n)
    white = np.concatenate([rest[:, :1], rest[:, 1:] - rho[:, None] * rest[:, :-1]], 1)
    spread = white.var(1, ddof=1)
    scale = np.divide(y.var(1, ddof=1), spread, out=np.full(len(y), np.nan), where=spread > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        corrected = np.where(rho > 0, beta / np.sqrt((1 + rho) / (1 - rho)), beta)
    out = np.where(change[:, None], white * scale[:, None] + corrected[:, None] * (t - t[0]), y)
    return out, rho, np.where(change, corrected, beta), change.astype(np.int32)


def variance_corrected(stack: Stack) -> tuple[Stack, DataFrame]:
    """The variance-corrected variant; series whose correlation is not significant stay as they are."""
    t = np.array(stack.spec.times)

    def run(batches):
        for b in batches:
            out, rho, beta, change = variance_corrected_rows(matrix(b.column(2)), t) if b.num_rows else (np.zeros((0, len(t))), *(np.zeros(0),) * 2, np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(out), pa.array(rho), pa.array(beta), pa.array(change)], names=["grid_id", "cell", "y", "Rho", "Beta_corrected", "Modified"])

    got = _kernel(stack, stack.cells.where("ok").select("grid_id", "cell", "y"), run, "y array<double>, Rho double, Beta_corrected double, Modified int")
    return _joined(stack, got, DIAGNOSTICS["VCTFPW"], stack.spec.n_time)


def _joined(stack: Stack, got: DataFrame, names: tuple[str, ...], n: int) -> tuple[Stack, DataFrame]:
    rows = stack.cells.select("grid_id", "cell", "row", "col", "ok").join(got, ["grid_id", "cell"], "left")
    missing = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.lit(None).cast("double"))
    cells = rows.select("grid_id", "cell", "row", "col", F.coalesce("y", missing).alias("y"))
    return with_series(stack, cells, n, stack.spec.times if n == stack.spec.n_time else ()), rows.select("grid_id", "cell", "row", "col", "ok", *names)


def straight_line_residuals(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    tc = t - t.mean()
    slope = ((y - y.mean(1, keepdims=True)) * tc).sum(1) / (tc * tc).sum()
    return y - (y.mean(1) - slope * t.mean())[:, None] - slope[:, None] * t


def durbin_watson_rows(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The statistic of each row's straight-line residuals; NaN where these vanish."""
    e = straight_line_residuals(y, t)
    square = (e * e).sum(1)
    return np.divide((np.diff(e, axis=1) ** 2).sum(1), square, out=np.full(len(y), np.nan), where=square != 0)


def correlation_path(y: np.ndarray, t: np.ndarray, itmax: int, refit: str) -> tuple[np.ndarray, np.ndarray]:
    """(rho, step) of each row: its values after 0 to itmax steps (whiten by rho, refit the trend, take the correlation of what
    is left), and the first step whose value was clamped (itmax + 1 if none was). A row whose value has come to rest is not refitted."""
    early = t[:-1]
    tc = early - early.mean()

    def trend(y, rho):
        u = (y[:, 1:] - rho[:, None] * y[:, :-1]) / (1 - rho[:, None])
        return sen_slopes(u, early) if refit == "TS" else ((u - u.mean(1, keepdims=True)) * tc).sum(1) / (tc * tc).sum()

    path, clamped = np.repeat(lag_one(y)[:, None], itmax + 1, 1), np.full(len(y), itmax + 1)
    moving = np.arange(len(y))
    with np.errstate(all="ignore"):
        for k in range(1, itmax + 1):
            rest = lag_one(y[moving] - trend(y[moving], path[moving, k - 1])[:, None] * t)
            clamped[moving] = np.where((clamped[moving] > itmax) & ((rest >= 1) | (rest <= -1)), k, clamped[moving])
            rest = np.where(rest >= 1, LIMIT, np.where(rest <= -1, -LIMIT, rest))
            path[moving, k:] = rest[:, None]
            moving = moving[rest != path[moving, k - 1]]
    return path, clamped


def iterative(stack: Stack, method: str, gate: str, dw_low: float, dw_high: float, dw_mode: str, refit: str, itmax: int, eps: float) -> tuple[Stack, DataFrame]:
    """Wang and Swail's iteration, for series that the Durbin-Watson gate passes (TFPW_WS) or for all (TFPW_Z)."""
    t, n = np.array(stack.spec.times), stack.spec.n_time
    if gate != "threshold":
        limit = dw_critical_values(n)[1 if dw_mode == "conservative" else 0]
        dw_low, dw_high = limit, 4 - limit

    def walk(batches):
        for b in batches:
            ok = b.column(4).to_numpy(zero_copy_only=False)
            y = matrix(b.column(5).filter(pa.array(ok))) if ok.any() else np.zeros((0, n))
            dw, at = np.full(len(ok), np.nan), np.flatnonzero(ok)
            path, clamped, gated = np.full((len(ok), itmax + 1), np.nan), np.full(len(ok), itmax + 1), np.zeros(len(ok), bool)
            if len(y):
                dw[at] = durbin_watson_rows(y, t)
                gated[at] = (dw[at] < dw_low) | (dw[at] > dw_high) if method == "TFPW_WS" else True
                path[gated], clamped[gated] = correlation_path(y[gated[at]], t, itmax, refit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dw, mask=np.isnan(dw)), pa.array(gated), _lists(path), pa.array(clamped.astype(np.int32))], names=[*b.schema.names, "dw", "gated", "path", "clamped"])

    def whiten(batches):
        for b in batches:
            ok, gated, stop = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ok", "gated", "stop"))
            y = np.full((len(ok), n), np.nan)
            if ok.any():
                y[ok] = matrix(b.column("y").filter(pa.array(ok)))
            rho = np.take_along_axis(matrix(b.column("path")), stop.astype(np.int64)[:, None], 1)[:, 0] if len(ok) else np.zeros(0)
            held = gated & (b.column("clamped").to_numpy() <= stop)
            change = gated & ~held
            r = rho[change, None]
            y[change] = np.concatenate([y[change, :1] * np.sqrt(1 - r * r), (y[change, 1:] - r * y[change, :-1]) / (1 - r)], 1)
            made = [pa.array(np.where(gated, rho, 0.0), mask=~ok), pa.array(change.astype(np.int32), mask=~ok), pa.array(held.astype(np.int32), mask=~ok)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grid_id", "cell", "row", "col", "ok")), _lists(y), b.column("dw"), *made], names=[*COLUMNS, "y", "DW_initial", "Rho", "Modified", "Clamped"])

    kind = dict(stack.cells.dtypes)["grid_id"]
    front = f"grid_id {kind}, cell long, row int, col int, ok boolean"
    rows = stack.cells.select("grid_id", F.col("cell").cast("long").alias("cell"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "ok", F.when(F.col("ok"), F.col("y")).alias("y"))
    rows = checkpointed(rows.mapInArrow(walk, f"{front}, y array<double>, dw double, gated boolean, path array<double>, clamped int"))
    steps = rows.where("gated").select("grid_id", F.posexplode(F.zip_with(S.tail(F.col("path")), S.head(F.col("path")), lambda a, b: F.abs(a - b))).alias("k", "move"))
    steps = steps.where(F.col("move").isNotNull() & ~F.isnan("move")).groupBy("grid_id", "k").agg(F.max("move").alias("move"))
    stop = steps.groupBy("grid_id").agg(F.coalesce(F.min(F.when(F.col("move") < eps, F.col("k") + 1)), F.lit(itmax)).cast("int").alias("stop"))  # one row per grid
    rows = rows.join(one_row_side(stop), "grid_id", "left").withColumn("stop", F.coalesce("stop", F.lit(itmax)))
    out = rows.mapInArrow(whiten, f"{front}, y array<double>, DW_initial double, Rho double, Modified int, Clamped int")
    return with_series(stack, out.select("grid_id", "cell", "row", "col", "y")), out.select(*COLUMNS, *DIAGNOSTICS[method])

"""Trend tests on each series: Mann-Kendall (classic, contextual, modified) and least squares."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import series as S
from gridloom.functions.dist import NORMAL_DENOMINATOR, NORMAL_NUMERATOR, SQRT_TWO_PI, Z_975, t_two_sided_sql
from gridloom.functions.kernels import kendall_scores, matrix, sen_slopes, with_statistics
from gridloom.operators import tiles
from gridloom.operators.grid import Stack, when_ok
from gridloom.operators.spatial import Neighbourhood, neighbourhood

if TYPE_CHECKING:
    from gridloom.operators.topology import Topology

SCHEMAS = {
    "MK": ("S", "VarS", "p"),
    "MMK": ("S", "VarS", "p"),
    "CMK": ("Sm", "VarSm", "p"),
    "OLS": ("beta", "se_beta", "p"),
}
METHODS = tuple(SCHEMAS)


def z_score(s: Column, variance: Column) -> Column:
    """(S - sign S) / sqrt(VarS); 0 where S is 0."""
    return F.when(s == 0, F.lit(0.0)).otherwise((s - F.signum(s)) / F.sqrt(variance))


def normal_p(z: Column) -> Column:
    """The two-sided p of z. z is bound first: the formula names it often, and z holds a whole kernel."""
    return F.get(F.transform(F.array(z), lambda x: _p_of(x)), F.lit(0))


def _p_of(x: Column) -> Column:
    a = F.abs(x)
    near = F.exp(-0.5 * a * a) * _polynomial(a, NORMAL_NUMERATOR) / _polynomial(a, NORMAL_DENOMINATOR)
    far = F.exp(-0.5 * a * a) / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * SQRT_TWO_PI)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, F.least(F.lit(1.0), 2 * near)).otherwise(2 * far)


def _polynomial(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def with_kendall(rows: DataFrame, ties: bool) -> DataFrame:
    """rows (ok, y, ...) with S and VarS of the complete series."""
    return with_statistics(rows, ("S", "VarS"), lambda y: kendall_scores(y, ties))


def trend_test(
    stack: Stack, method: str = "CMK", ties: bool = True, window_size: int = 3, connectivity: str = "queen",
    precomputed: Neighbourhood | Topology | None = None, continuity: bool = False,
) -> DataFrame:
    """grid_id, cell, row, col, ok and the three columns of SCHEMAS[method]; null for incomplete series."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    least = {"MK": 2, "CMK": 2, "OLS": 3, "MMK": 4}[method]
    if stack.spec.n_time < least:
        raise ValueError(f"{method} needs {least} layers or more")
    run = {"MK": lambda: mann_kendall(stack, ties), "OLS": lambda: least_squares(stack), "MMK": lambda: modified_mann_kendall(stack, ties)}
    rows = contextual_mann_kendall(stack, ties, window_size, connectivity, precomputed, continuity) if method == "CMK" else run[method]()
    return rows.select("grid_id", "cell", "row", "col", "ok", *SCHEMAS[method])


def mann_kendall(stack: Stack, ties: bool = True) -> DataFrame:
    rows = with_kendall(stack.cells.select("grid_id", "cell", "row", "col", "ok", "y"), ties).drop("y")
    return rows.withColumn("p", normal_p(z_score(F.col("S"), F.col("VarS"))))


def least_squares(stack: Stack) -> DataFrame:
    """Slope, its standard error, and the two-sided p of t with n - 2 degrees of freedom (0 / 0 counts as no trend)."""
    df = stack.spec.n_time - 2

    def of(f: Column) -> Column:
        ratio = F.when(f["se"] > 0, f["slope"] / f["se"]).when(f["slope"] == 0, F.lit(0.0)).otherwise(F.signum(f["slope"]) * F.lit(1e300))
        return F.struct(f["slope"].alias("beta"), f["se"].alias("se_beta"), ratio.alias("tstat"))

    rows = stack.cells.select("grid_id", "cell", "row", "col", "ok", when_ok(S.let(S.ols(F.col("y"), stack.spec.t()), of)).alias("f"))
    rows = rows.select("grid_id", "cell", "row", "col", "ok", F.inline_outer(F.array("f")))
    return rows.withColumn("p", F.expr(t_two_sided_sql("tstat", df)))


def contextual_mann_kendall(
    stack: Stack, ties: bool = True, window_size: int = 3, connectivity: str = "queen", precomputed: Neighbourhood | Topology | None = None, continuity: bool = False,
) -> DataFrame:
    """Mann-Kendall of neighbourhood means.

    With v = sqrt(s2) (y - mean) / (sqrt(n) sd), the variance of a region's mean score is
    (|sum v|^2 + sum (s2 - |v|^2)) / m^2, so a region needs the sum of a vector and of two numbers, by tile, and
    no pair of cells is ever formed. The means are over the cell and its m - 1 complete neighbours.
    """
    around = precomputed or neighbourhood(stack.spec, connectivity, window_size)
    if isinstance(around, Neighbourhood):
        around.check(stack.spec, connectivity, window_size)
    else:  # a topology, made for a mask
        around.check(stack.spec, connectivity, window_size, stack.cells.where("ok"))
    n = stack.spec.n_time

    def region(y: Column, k: dict[str, Column]) -> Column:
        """struct(S, own, v) from a series and its S and VarS."""
        def scaled(c: Column) -> Column:
            sd = F.sqrt(S.dot(c, c) / (n - 1))
            return S.let(F.when(sd > 0, F.sqrt(k["VarS"]) / (F.sqrt(F.lit(float(n))) * sd)).otherwise(F.lit(0.0)), lambda f: F.transform(c, lambda x: x * f))

        return S.let(S.let(S.centred(y), scaled), lambda v: F.struct(k["S"].alias("score"), (k["VarS"] - S.dot(v, v)).alias("own"), v.alias("v")))

    scored = with_kendall(stack.cells.where("ok").select("grid_id", "row", "col", "ok", "y"), ties)
    rows = scored.select("grid_id", "row", "col", region(F.col("y"), {"S": F.col("S"), "VarS": F.col("VarS")}).alias("k"))
    rows = rows.select("grid_id", "row", "col", F.inline(F.array("k")))  # one row each: the kernels are not copied past this point

    def kernel(keys, block, reach):
        add = lambda x: tiles.window_sums(x, reach, connectivity, include_self=True)
        m = np.maximum(add(block["present"]), 1)
        return {"present": tiles.inner(block["present"], reach), "Sm0": add(block["score"]) / m, "V0": ((add(block["v"]) ** 2).sum(2) + add(block["own"])) / (m * m)}

    sums = tiles.by_tile(rows, (stack.spec.nrow, stack.spec.ncol), window_size // 2, ("grid_id",), kernel, "Sm0 double, V0 double").drop("row", "col")
    out = stack.cells.select("grid_id", "cell", "row", "col", "ok").join(sums, ["grid_id", "cell"], "left")
    out = out.withColumn("Sm", when_ok(F.col("Sm0"))).withColumn("VarSm", when_ok(F.col("V0")))
    top = F.when(F.col("Sm") > 0, F.col("Sm") - 1).otherwise(F.col("Sm") + 1) if continuity else F.col("Sm")
    z = F.when(F.col("VarSm") > 0, top / F.sqrt("VarSm")).when((F.col("VarSm") <= 0) & (top == 0), F.lit(0.0)).when(F.col("VarSm") <= 0, F.signum(top) * 1e300)
    return out.withColumn("p", normal_p(z))


# ------------------------------------------------------------------ modified Mann-Kendall (numpy in Arrow batches)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of each row, ties sharing their mean: n log n a row, no pairs in memory."""
    n = x.shape[1]
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, 1)
    new = np.concatenate([np.ones((len(x), 1), bool), ordered[:, 1:] != ordered[:, :-1]], 1)
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    after = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(after, place, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows by lags 1 to ``lags``; 0 for constant rows."""
    c = x - x.mean(1, keepdims=True)
    full = (c * c).sum(1)
    out = np.stack([(c[:, k:] * c[:, :-k]).sum(1) for k in range(1, lags + 1)], 1)
    return np.divide(out, full[:, None], out=np.zeros_like(out), where=full[:, None] > 0)


def essential_factor(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Variance correction of Hamed and Rao from the significant autocorrelations of the ranks of the detrended series."""
    n = y.shape[1]
    ranks = average_ranks(y - sen_slopes(y, t)[:, None] * t)
    r = autocorrelations(ranks, n - 1)
    r[np.abs(r) <= Z_975 / np.sqrt(n)] = 0
    k = np.arange(1, n)
    return 1 + 2 / (n * (n - 1) * (n - 2)) * (((n - k) * (n - k - 1) * (n - k - 2)) * r).sum(1)


def modified_mann_kendall(stack: Stack, ties: bool = True) -> DataFrame:
    t = np.array(stack.spec.times)

    def run(batches):
        for b in batches:
            y = matrix(b.column(2))
            factor = np.concatenate([essential_factor(y[k : k + 512], t) for k in range(0, len(y), 512)]) if len(y) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(factor)], names=["grid_id", "cell", "essf"])

    kind = dict(stack.cells.dtypes)["grid_id"]
    factors = stack.cells.where("ok").select("grid_id", "cell", "y").mapInArrow(run, f"grid_id {kind}, cell long, essf double")
    rows = with_kendall(stack.cells.select("grid_id", "cell", "row", "col", "ok", "y"), ties).drop("y").withColumnRenamed("VarS", "V0").join(factors, ["grid_id", "cell"], "left")
    rows = rows.withColumn("VarS", F.when(F.col("essf") > 0, F.col("V0") * F.col("essf")))
    return rows.withColumn("p", F.when(F.col("essf") > 0, normal_p(z_score(F.col("S"), F.col("VarS")))))

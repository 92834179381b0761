"""Statistics of one series as Spark expressions over arrays (no Python on the executors).

y and t are columns of equal-length arrays of doubles without nulls; callers guard incomplete series.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body) -> Column:
    """body(value), with value computed once (expressions inside lambdas are not shared)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def centred(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def tail(a: Column, k: int = 1) -> Column:
    """All but the first k elements."""
    return F.slice(a, F.lit(k + 1), F.size(a))


def head(a: Column, k: int = 1) -> Column:
    """All but the last k elements."""
    return F.slice(a, F.lit(1), F.size(a) - k)


def kendall_score(y: Column) -> Column:
    """Sum over i < j of sign(y_j - y_i)."""
    rows = F.transform(F.sequence(F.lit(2), F.size(y)), lambda j: let(F.element_at(y, j), lambda v: F.aggregate(F.slice(y, F.lit(1), j - 1), F.lit(0.0), lambda s, x: s + F.signum(v - x))))
    return F.when(F.size(y) < 2, F.lit(0.0)).otherwise(total(rows))


def tie_term(y: Column) -> Column:
    """Sum over groups of g equal values of g (g - 1) (2 g + 5)."""
    def of(x: Column) -> Column:
        return let(F.size(F.filter(y, lambda z: z == x)), lambda g: ((g - 1) * (2 * g + 5)).cast("double"))

    return total(F.transform(y, of))


def kendall_variance(y: Column, ties: bool) -> Column:
    n = F.size(y).cast("double")
    full = n * (n - 1) * (2 * n + 5)
    return (full - tie_term(y)) / 18 if ties else full / 18


def pair_slopes(y: Column, t: Column) -> Column:
    """(y_j - y_i) / (t_j - t_i) of all pairs i < j, in ascending order."""
    def from_i(i: Column) -> Column:
        return F.zip_with(tail_from(y, i), tail_from(t, i), lambda v, s: (v - F.element_at(y, i)) / (s - F.element_at(t, i)))

    return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), F.size(y) - 1), from_i)))


def tail_from(a: Column, i: Column) -> Column:
    return F.slice(a, i + 1, F.size(a))


def sorted_median(a: Column) -> Column:
    """Ordinary median of a sorted array: the mean of the two middle elements when their number is even."""
    k = F.size(a)
    low, high = F.floor((k + 1) / 2).cast("int"), (F.floor(k / 2) + 1).cast("int")
    return (F.element_at(a, low) + F.element_at(a, high)) / 2


def sorted_upper_median(a: Column) -> Column:
    """Element floor(k / 2) + 1 of a sorted array of k elements."""
    return F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))


def theil_sen(y: Column, t: Column) -> Column:
    return let(pair_slopes(y, t), sorted_median)


def ols(y: Column, t: Column) -> Column:
    """struct(slope, intercept, se, rss): residual sum in a second pass, since differences of squares lose digits."""
    def fit(tc: Column) -> Column:
        return let(F.struct((dot(tc, centred(y)) / dot(tc, tc)).alias("slope"), dot(tc, tc).alias("sxx")), residuals)

    def residuals(f: Column) -> Column:
        icpt = mean(y) - f["slope"] * mean(t)
        rss = let(icpt, lambda b: total(F.zip_with(y, t, lambda v, s: (v - b - f["slope"] * s) * (v - b - f["slope"] * s))))
        return let(rss, lambda r: F.struct(
            f["slope"].alias("slope"), icpt.alias("intercept"), F.sqrt(r / (F.size(y) - 2) / f["sxx"]).alias("se"), r.alias("rss")))

    return let(centred(t), fit)


def ols_residuals(y: Column, t: Column) -> Column:
    return let(ols(y, t), lambda f: F.zip_with(y, t, lambda v, s: v - f["intercept"] - f["slope"] * s))


def autocorrelation(y: Column, lag: int | Column = 1) -> Column:
    """Lagged products of deviations over the full sum of squares; 0 for a constant series."""
    lag = F.lit(lag) if isinstance(lag, int) else lag

    def of(c: Column) -> Column:
        above = total(F.zip_with(F.slice(c, lag + 1, F.size(c)), F.slice(c, F.lit(1), F.size(c) - lag), lambda a, b: a * b))
        return let(dot(c, c), lambda d: F.when(d == 0, F.lit(0.0)).otherwise(above / d))

    return let(centred(y), of)


def durbin_watson(y: Column, t: Column) -> Column:
    """struct(dw, rho1) of the straight-line residuals; null where residuals vanish."""
    def of(e: Column) -> Column:
        steps = total(F.zip_with(tail(e), head(e), lambda a, b: (a - b) * (a - b)))
        cross = dot(tail(e), head(e))
        return F.struct((steps / F.nullif(dot(e, e), F.lit(0.0))).alias("dw"), (cross / F.nullif(dot(head(e), head(e)), F.lit(0.0))).alias("rho1"))

    return let(ols_residuals(y, t), of)

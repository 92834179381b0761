"""Distribution functions as SQL text that Spark and other engines evaluate alike, and numeric kernels.

The SQL builders take and return expression text, so a query and its oracle can share one formula.
"""

from __future__ import annotations

import math

import numpy as np

# Hart's rational approximation of the normal tail, highest power first.
NORMAL_NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SQRT_TWO_PI = 2.5066282746310002
Z_975 = 1.959963984540054


def _horner(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _double(number: float) -> str:
    return f"cast({number!r} as double)"


def normal_two_sided_sql(z: str) -> str:
    """2 (1 - Phi(|z|)) with the tail computed directly, so that small values keep their digits."""
    a = f"abs({z})"
    tail = f"exp(-0.5 * {a} * {a}) * ({_horner(a, NORMAL_NUMERATOR)}) / ({_horner(a, NORMAL_DENOMINATOR)})"
    far = f"exp(-0.5 * {a} * {a}) / (({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) * {SQRT_TWO_PI!r})"
    return f"(case when {z} is null then null when {a} > 37 then cast(0 as double) when {a} < 7.07106781186547 then least(cast(1 as double), 2 * {tail}) else 2 * {far} end)"


def t_two_sided_sql(t: str, df: int) -> str:
    """P(|T| >= |t|) for a whole number of degrees of freedom: a finite sum in the angle atan(|t| / sqrt(df))."""
    root = _double(math.sqrt(df))
    angle = f"atan(abs({t}) / {root})"
    c2 = f"({_double(float(df))} / ({_double(float(df))} + ({t}) * ({t})))"
    sine = f"(abs({t}) / sqrt({_double(float(df))} + ({t}) * ({t})))"
    cosine = f"sqrt({c2})"
    if df % 2:
        weights, w = [], 1.0
        for k in range(1, (df - 1) // 2 + 1):
            weights.append(w)
            w *= 2 * k / (2 * k + 1)
        series = f"{sine} * {cosine} * ({_horner(c2, weights[::-1])})" if weights else "0.0"
        inside = f"({_double(2 / math.pi)} * ({angle} + {series}))"
    else:
        weights, w = [], 1.0
        for k in range(1, df // 2 + 1):
            weights.append(w)
            w *= (2 * k - 1) / (2 * k)
        inside = f"({sine} * ({_horner(c2, weights[::-1])}))"
    return f"(case when {t} is null then null when abs({t}) > 1e150 then cast(0 as double) else greatest(cast(0 as double), 1 - {inside}) end)"


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _bisect(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), p, -40, 40)


def t_cdf(t: float, df: float) -> float:
    """Student's t through the regularised incomplete beta function (any positive df)."""
    x = df / (df + t * t)
    tail = 0.5 * incomplete_beta(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    span = 1.0
    while t_cdf(span, df) < max(p, 1 - p) and span < 1e12:
        span *= 2
    return _bisect(lambda x: t_cdf(x, df), p, -span, span)


def _bisect(f, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if f(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out / a


def bessel_k(order: float, x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of the second kind: trapezoid rule on the integral of exp(-x cosh u) cosh(order u)."""
    x = np.asarray(x, float)
    u = np.linspace(0, 20, 4_001)
    with np.errstate(over="ignore", under="ignore"):
        f = np.exp(-x[..., None] * np.cosh(u) + np.log(np.cosh(np.minimum(order * u, 700.0))))
    return np.trapezoid(f, u, axis=-1)

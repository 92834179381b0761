import math

import numpy as np
import pytest
from helpers import by_cell, stack_of

from gridloom.functions import kernels
from gridloom.functions.dist import t_cdf
from gridloom.operators import anomalies, prewhiten, slope, trend
from gridloom.operators import slope as slope_module

RNG = np.random.default_rng(11)


def kendall(y):
    return sum(np.sign(y[j] - y[i]) for i in range(len(y)) for j in range(i + 1, len(y)))


def sen(y, t):
    return np.median([(y[j] - y[i]) / (t[j] - t[i]) for i in range(len(y)) for j in range(i + 1, len(y))])


def acf1(x):
    c = x - x.mean()
    return (c[1:] * c[:-1]).sum() / (c * c).sum()


def test_kendall_scores_and_ties(spark):
    stack = stack_of(spark, [[1, 2, 3, 4], [1, 2, 2, 4], [5, 5, 5, 5], [1, None, 2, 3]])
    got = by_cell(trend.trend_test(stack, "MK", ties=True), "S", "VarS", "p")
    assert got[1][:2] == (6, 156 / 18) and got[2][:2] == (5, 138 / 18)
    assert got[3][0] == 0 and got[3][2] == 1
    assert got[4] == (None, None, None)
    z = 5 / math.sqrt(156 / 18)
    assert got[1][2] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_kendall_is_odd_and_order_free(spark):
    y = RNG.normal(size=(3, 9))
    stack = stack_of(spark, [*y, *(-y), *np.exp(y)])
    got = by_cell(trend.trend_test(stack, "MK"), "S")
    for i in range(3):
        assert got[i + 1] == kendall(y[i]) == -got[i + 4] == got[i + 7]


def test_least_squares(spark):
    y = [1.2, 2.6, 1.9, 3.4, 2.8, 4.5, 3.6, 5.2, 4.4, 6.1]
    got = by_cell(trend.trend_test(stack_of(spark, [y, [2.0] * 10]), "OLS"), "beta", "se_beta", "p")
    t = np.arange(1, 11)
    b, a = np.polyfit(t, y, 1)
    se = math.sqrt(((np.array(y) - a - b * t) ** 2).sum() / 8 / ((t - t.mean()) ** 2).sum())
    assert got[1] == pytest.approx((b, se, 2 * (1 - t_cdf(b / se, 8))), rel=1e-8)
    assert got[2] == (0, 0, 1)


def test_irregular_time_axis(spark):
    times = (2000, 2001, 2003, 2004, 2008, 2009)
    y = [1.0, 2.5, 2.0, 4.0, 7.0, 6.5]
    stack = stack_of(spark, [y], times=times)
    assert by_cell(slope.slope_estimator(stack, "OLS"), "slope")[1] == pytest.approx(np.polyfit(times, y, 1)[0])
    assert by_cell(slope.slope_estimator(stack, "TS"), "slope")[1] == pytest.approx(sen(y, times))


def test_theil_sen_and_intervals(spark):
    stack = stack_of(spark, [[1, 3, 2, 6]])
    got = by_cell(slope.fit_series(stack, "TS"), "slope", "lower", "upper")[1]
    assert got == pytest.approx((19 / 12, -1, 4))
    line = stack_of(spark, [[2 + 0.5 * t for t in range(1, 16)]])
    for m in slope.METHODS:
        assert by_cell(slope.slope_estimator(line, m), "slope")[1] == pytest.approx(0.5)


def test_sampled_pairs_are_a_fixed_subset():
    assert slope.sampled_pairs(10, 1e5) is None
    some = slope.sampled_pairs(30, 50)
    assert len(set(some)) == 50 and some == slope.sampled_pairs(30, 50) and all(i < j for i, j in some)


def test_repeated_median(spark):
    y, t = RNG.normal(size=8), np.arange(1, 9)
    upper = lambda x: sorted(x)[len(x) // 2]
    want = upper([upper([(y[j] - y[i]) / (t[j] - t[i]) for j in range(8) if j != i]) for i in range(8)])
    assert by_cell(slope.slope_estimator(stack_of(spark, [y]), "RM"), "slope")[1] == pytest.approx(want)


def test_modified_mann_kendall(spark):
    y = np.cumsum(RNG.normal(size=20))
    t = np.arange(1, 21)
    n = 20
    x = y - sen(y, t) * t
    r = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    c = r - r.mean()
    rho = [(c[k:] * c[:-k]).sum() / (c * c).sum() for k in range(1, n)]
    f = 1 + 2 / (n * (n - 1) * (n - 2)) * sum((n - k) * (n - k - 1) * (n - k - 2) * p for k, p in enumerate(rho, 1) if abs(p) > 1.959963984540054 / math.sqrt(n))
    got = by_cell(trend.trend_test(stack_of(spark, [y]), "MMK"), "S", "VarS")[1]
    assert got[0] == kendall(y)
    assert got[1] == (pytest.approx(n * (n - 1) * (2 * n + 5) / 18 * f) if f > 0 else None)


def test_contextual_mann_kendall_from_pairwise_covariances(spark):
    y = RNG.integers(0, 6, size=(9, 6)).astype(float)
    stack = stack_of(spark, y, nrow=3)
    got = by_cell(trend.trend_test(stack, "CMK"), "Sm", "VarSm")
    n = 6
    u = np.array([(r - r.mean()) / (math.sqrt(n) * r.std(ddof=1)) if r.std() else r * 0 for r in y])
    var = np.array([(n * (n - 1) * (2 * n + 5) - sum(g * (g - 1) * (2 * g + 5) for g in np.unique(r, return_counts=True)[1])) / 18 for r in y])
    for cell in range(9):
        near = [b for b in range(9) if abs(b // 3 - cell // 3) <= 1 and abs(b % 3 - cell % 3) <= 1]
        m = len(near)
        v = sum(var[a] if a == b else (u[a] @ u[b]) * math.sqrt(var[a] * var[b]) for a in near for b in near) / m**2
        assert got[cell + 1] == pytest.approx((sum(kendall(y[b]) for b in near) / m, v))


def test_contextual_continuity_moves_a_zero_score(spark):
    stack = stack_of(spark, [[1, 2, 2, 1]] * 4, nrow=2)
    plain, moved = (by_cell(trend.trend_test(stack, "CMK", continuity=c), "Sm", "p")[1] for c in (False, True))
    assert plain == (0, 1) and moved[0] == 0 and moved[1] < 1


def test_durbin_watson_and_critical_values(spark):
    y, t = RNG.normal(size=12), np.arange(1, 13)
    e = y - np.polyval(np.polyfit(t, y, 1), t)
    got = by_cell(prewhiten.durbin_watson(stack_of(spark, [y])), "dw", "rho1")[1]
    assert got == pytest.approx((((e[1:] - e[:-1]) ** 2).sum() / (e * e).sum(), (e[1:] * e[:-1]).sum() / (e[:-1] ** 2).sum()))
    assert prewhiten.dw_critical_values(15) == (1.077, 1.361) == prewhiten.dw_critical_values(4)
    assert prewhiten.dw_critical_values(42) == pytest.approx((1.4552, 1.5528))


def test_trend_free_prewhitening(spark):
    y, t = np.cumsum(RNG.normal(size=15)), np.arange(1, 16)
    b = sen(y, t)
    r = y - b * t
    rho = max(-0.99, min(0.99, acf1(r)))
    out, d = prewhiten.prewhiten(stack_of(spark, [y, [1.0 * k for k in range(15)]]), "TFPW_Y")
    got = by_cell(out.cells, "y")
    assert got[1] == pytest.approx(list(r[1:] - rho * r[:-1] + b * t[1:]))
    assert got[2] == [None] * 14 and by_cell(d, "Rho")[2] is None and out.spec.n_time == 14


def test_variance_corrected_prewhitening(spark):
    y, t = np.cumsum(RNG.normal(size=30)), np.arange(1, 31)
    b = sen(y, t)
    d0 = y - b * (t - 1)
    rho = acf1(d0)
    r = np.append(d0[:1], d0[1:] - rho * d0[:-1])
    want = r * y.var(ddof=1) / r.var(ddof=1) + (b / math.sqrt((1 + rho) / (1 - rho)) if rho > 0 else b) * (t - 1)
    out, d = prewhiten.prewhiten(stack_of(spark, [y, RNG.permutation(30)]), "VCTFPW")
    assert by_cell(d, "Modified")[1] == 1 and by_cell(out.cells, "y")[1] == pytest.approx(list(want))


def iterate(ys, itmax=20, eps=1e-4):
    """The iteration with its common stop, one series after another."""
    n = ys.shape[1]
    t = np.arange(1.0, n + 1)

    def fit(y, rho):
        u = (y[1:] - rho * y[:-1]) / (1 - rho)
        return np.polyfit(t[:-1], u, 1)[0]

    rho = np.array([acf1(y) for y in ys])
    b = np.array([fit(y, p) for y, p in zip(ys, rho)])
    clamped = np.zeros(len(ys), bool)
    for _ in range(itmax):
        new = np.array([acf1(y - s * t) for y, s in zip(ys, b)])
        clamped |= np.abs(new) >= 1
        new = np.clip(new, -0.99, 0.99)
        moved = np.abs(new - rho).max()
        rho, b = new, np.array([fit(y, p) for y, p in zip(ys, new)])
        if moved < eps:
            break
    return rho, clamped


@pytest.mark.parametrize("method", ["TFPW_Z", "TFPW_WS"])
def test_iterative_prewhitening_stops_for_all_cells_at_once(spark, method):
    ys = np.cumsum(RNG.normal(size=(6, 25)), 1) + 0.2 * np.arange(25)
    out, d = prewhiten.prewhiten(stack_of(spark, ys), method, dw_low=1.0)
    gated = by_cell(d, "Modified")
    t = np.arange(1, 26)
    residuals = [y - np.polyval(np.polyfit(t, y, 1), t) for y in ys]
    dw = np.array([(np.diff(e) ** 2).sum() / (e * e).sum() for e in residuals])
    pick = np.flatnonzero((dw < 1.0) | (dw > 2.6)) if method == "TFPW_WS" else np.arange(6)
    rho, _ = iterate(ys[pick])
    got_rho, got_y = by_cell(d, "Rho"), by_cell(out.cells, "y")
    for k, i in enumerate(pick):
        y, p = ys[i], rho[k]
        assert gated[i + 1] == 1 and got_rho[i + 1] == pytest.approx(p, abs=1e-9)
        assert got_y[i + 1] == pytest.approx([y[0] * math.sqrt(1 - p * p), *((y[1:] - p * y[:-1]) / (1 - p))])
    for i in set(range(6)) - set(pick):
        assert gated[i + 1] == 0 and got_rho[i + 1] == 0 and got_y[i + 1] == pytest.approx(list(ys[i]))


def test_no_complete_series_is_refused(spark):
    with pytest.raises(ValueError):
        prewhiten.prewhiten(stack_of(spark, [[1, None, 2, 3, 4]]), "VCTFPW")


def test_anomalies(spark):
    rows = [("g", 1, k + 1, float(v)) for k, v in enumerate([10, 20, 30, 12, 22, 32])] + [("g", 2, k + 1, v) for k, v in enumerate([10.0, 20.0, 30.0, 10.0, None, 32.0])]
    long = spark.createDataFrame(rows, "grid_id string, cell long, t int, value double")
    got = {(r["cell"], r["t"]): r["anomaly"] for r in anomalies.anomalies(long, 6, 3).collect()}
    assert [got[1, k] for k in range(1, 7)] == [-1, -1, -1, 1, 1, 1] and got[2, 2] == 0 and got[2, 5] is None
    got = {(r["cell"], r["t"]): r["anomaly"] for r in anomalies.anomalies(long, 6, 3, standardise=True).collect()}
    assert got[1, 1] == pytest.approx(-1 / math.sqrt(2)) and got[2, 1] is None
    with pytest.raises(ValueError):
        anomalies.anomalies(long, 6, 7)


def all_slopes(y, t):
    i, j = np.triu_indices(len(t), 1)
    return np.sort((y[j] - y[i]) / (t[j] - t[i]))


@pytest.mark.parametrize("n", [129, 200, 257])
def test_long_scores_equal_pairs(n, monkeypatch):
    y = np.concatenate([RNG.normal(size=(3, n)), RNG.integers(0, 7, (3, n)), np.ones((1, n)), np.arange(n)[None, ::-1]]).astype(float)
    for ties in (True, False):
        long = kernels.kendall_scores(y, ties)
        monkeypatch.setattr(kernels, "SHORT", n)
        short = kernels.kendall_scores(y, ties)
        monkeypatch.undo()
        assert (long[0] == short[0]).all() and long[1] == pytest.approx(short[1])


@pytest.mark.parametrize("kind", ["noise", "trend", "whole numbers", "many zeros", "constant", "line", "tenths", "uneven times"])
def test_selected_slopes_equal_sorted_pairs(kind, monkeypatch):
    n = 420
    noise, t = RNG.normal(size=n), np.arange(1.0, n + 1)
    if kind == "uneven times":
        t = np.cumsum(RNG.random(n) + 0.01)
    y = {"trend": t * 0.3 + noise, "whole numbers": RNG.integers(0, 5, n).astype(float), "many zeros": np.where(RNG.random(n) < 0.7, 0, noise), "constant": np.ones(n), "line": 0.1 * t, "tenths": np.round(noise, 1)}.get(kind, noise)
    want = all_slopes(y, t)
    for rank in (0, 5, len(want) // 3, (len(want) - 1) // 2, len(want) // 2, len(want) - 1):
        assert kernels._selected(y, t, rank) == want[rank]
        monkeypatch.setattr(kernels, "PAIRS", 4_000)
        assert kernels._scanned(y, t, rank) == want[rank]
        monkeypatch.undo()


def test_long_series_take_little_memory():
    import tracemalloc

    n = 10_000
    t = np.arange(1.0, n + 1)
    y = RNG.normal(size=(1, n)) + t * 1e-4
    tracemalloc.start()
    slope, score, lower, upper = kernels.sen_slopes(y, t)[0], kernels.kendall_scores(y, True)[0][0], *slope_module.sen_interval(y, t)
    kernels.repeated_medians(y[:, :5_000], t[:5_000])
    assert tracemalloc.get_traced_memory()[1] < 100e6 and lower[0] < slope < upper[0]
    tracemalloc.stop()
    below = sum(int(((y[0, k + 1 :] - y[0, k]) / (t[k + 1 :] - t[k]) < slope).sum()) for k in range(n - 1))
    rising = sum(int(np.sign(y[0, k + 1 :] - y[0, k]).sum()) for k in range(n - 1))
    assert below == n * (n - 1) // 4 and score == rising


def test_repeated_medians_by_loops(monkeypatch):
    t = np.arange(1.0, 12)
    y = np.concatenate([RNG.normal(size=(4, 11)), RNG.integers(0, 3, (4, 11)).astype(float)])
    upper = lambda v: sorted(v)[len(v) // 2]
    for pairs in (2_000_000, 30):
        monkeypatch.setattr(kernels, "PAIRS", pairs)
        slopes, intercepts = kernels.repeated_medians(y, t), kernels.repeated_medians(y, t, intercepts=True)
        for r, v in enumerate(y):
            s = [[(v[j] - v[i]) / (t[j] - t[i]) for j in range(11) if j != i] for i in range(11)]
            assert slopes[r] == upper([upper(x) for x in s])
            assert intercepts[r] == pytest.approx(upper([upper([v[i] - b * t[i] for b in s[i]]) for i in range(11)]))

"""Windows by tile against windows taken cell by cell, permutations without sorting, and their two ways."""

import numpy as np
import pytest
from helpers import by_cell, field_of
from pyspark.sql import functions as F

from gridloom.functions.feistel import permute
from gridloom.operators import permutation, spatial, tiles

RNG = np.random.default_rng(12)


def window(x, r, c, reach, rook=False):
    rows, cols = np.indices(x.shape)
    near = (abs(rows - r) <= reach) & (abs(cols - c) <= reach)
    return near & ((rows == r) | (cols == c)) if rook else near


@pytest.mark.parametrize("reach", [1, 2, 3, 15])
def test_window_sums_and_medians(reach):
    x = np.where(RNG.random((40, 37)) < 0.2, np.nan, RNG.normal(size=(40, 37)))
    for kind in ("queen", "rook"):
        want = np.array([[np.nansum(np.where(window(x, r, c, reach, kind == "rook"), x, 0)) for c in range(reach, 37 - reach)] for r in range(reach, 40 - reach)])
        assert tiles.window_sums(x, reach, kind, include_self=True) == pytest.approx(want, abs=1e-12)
        own = np.nan_to_num(tiles.inner(x, reach))
        assert tiles.window_sums(x, reach, kind) == pytest.approx(want - own, abs=1e-12)
    want = np.array([[np.nanmedian(x[window(x, r, c, reach)]) for c in range(reach, 37 - reach)] for r in range(reach, 40 - reach)])
    assert tiles.window_medians(x, reach) == pytest.approx(want)
    assert np.isnan(tiles.window_medians(np.full((2 * reach + 1,) * 2, np.nan), reach)).all()


@pytest.mark.parametrize("size", [3, 9, 31])
def test_windows_cross_tiles(spark, size):
    nrow, ncol, reach = 70, 45, size // 2
    x = np.where(RNG.random((nrow, ncol)) < 0.1, np.nan, RNG.normal(size=(nrow, ncol)))
    field, spec = field_of(spark, [None if np.isnan(v) else float(v) for v in x.ravel()], nrow)
    some = [(r, c) for r in range(nrow) for c in range(ncol) if not np.isnan(x[r, c]) and (r * 7 + c) % 11 == 0]
    medians = by_cell(spatial.focal_median(field, "x", spec, size), "x")
    means = by_cell(spatial.focal_mean(field.withColumn("t", F.lit(1)), "x", spec, size), "x")
    lags = by_cell(spatial.lagged(field.where("x is not null"), spec, "queen", size, "x"), "wz", "k")
    for r, c in some:
        near = x[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1]
        cell = r * ncol + c + 1
        assert medians[cell] == pytest.approx(np.nanmedian(near)) and means[cell] == pytest.approx(np.nanmean(near))
        assert lags[cell] == (pytest.approx(np.nansum(near) - x[r, c], abs=1e-9), (~np.isnan(near)).sum() - 1)
    assert len(medians) == nrow * ncol and all(medians[r * ncol + c + 1] is None for r, c in np.argwhere(np.isnan(x)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_feistel_permutes(n):
    perms = np.arange(1, 6)
    to = permute(np.arange(n)[:, None], n, 7, perms[None, :])
    assert all(sorted(to[:, k].tolist()) == list(range(n)) for k in range(5))
    assert (permute(to, n, 7, perms[None, :], inverse=True) == np.arange(n)[:, None]).all()
    assert n < 5 or (len({tuple(to[:, k]) for k in range(5)}) == 5 and (to != permute(np.arange(n)[:, None], n, 8, perms[None, :])).any())


def test_permuted_places_are_even():
    to = permute(np.arange(60)[:, None], 60, 3, np.arange(1, 6001)[None, :])
    assert np.abs(np.bincount(to[17], minlength=60) - 100).max() < 50 and abs(np.corrcoef(to[4], to[5])[0, 1]) < 0.06


@pytest.mark.parametrize("method", ["moran", "getis_ord"])
def test_both_ways_agree_with_a_loop(spark, method):
    nrow, ncol, nperm = 35, 8, 7
    x = np.where(RNG.random((nrow, ncol)) < 0.1, np.nan, RNG.random((nrow, ncol)) + 1)
    field, spec = field_of(spark, [None if np.isnan(v) else float(v) for v in x.ravel()], nrow)
    both = [permutation.local_test(field, spec, method=method, nperm=nperm, seed=5, broadcast_cells=n).collect() for n in (10_000, 10)]
    near = lambda rows: {r["cell"]: tuple(r[c] if r[c] is None else round(float(r[c]), 9) for c in ("statistic", "null_mean", "null_sd", "z", "p")) for r in rows}
    assert near(both[0]) == near(both[1])
    one, two = (permutation.global_test(field, spec, method=method, nperm=nperm, seed=5, broadcast_cells=n).first() for n in (10_000, 10))
    assert all(one[c] == pytest.approx(two[c]) for c in ("statistic", "n", "s0", "null_min", "null_mean", "null_sd", "p", "z"))
    valid = np.argwhere(~np.isnan(x))
    values = x[tuple(valid.T)]

    def statistics(v):
        z = np.full(x.shape, np.nan)
        z[tuple(valid.T)] = v - v.mean() if method == "moran" else v
        out = {}
        for r, c in valid:
            sums = np.nansum(z[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]) - z[r, c]
            out[r * ncol + c + 1] = z[r, c] * sums / np.nanmean(z**2) if method == "moran" else (sums + z[r, c]) / np.nansum(z)
        return out

    observed = statistics(values)
    null = [statistics(values[permute(np.arange(len(values)), len(values), 5, np.int64(k))]) for k in range(1, nperm + 1)]
    for r in both[0]:
        draws = np.array([m[r["cell"]] for m in null])
        assert r["statistic"] == pytest.approx(observed[r["cell"]]) and r["null_mean"] == pytest.approx(draws.mean()) and r["null_sd"] == pytest.approx(draws.std(ddof=1))
        assert r["p"] == pytest.approx(((abs(draws - draws.mean()) >= abs(r["statistic"] - draws.mean())).sum() + 1) / (nperm + 1))
    total = permutation.local_summary(permutation.local_test(field, spec, method=method, nperm=nperm, seed=5), method, nperm=nperm).first()
    assert (total["N"], total["N_tested"]) == (len(values), len(values)) and total["raw_p_min"] == min(r["p"] for r in both[0]) and total["statistic_max"] == pytest.approx(max(observed.values()))
    kept = permutation.permuted(field, "x", 3, 5).collect()
    assert all(sorted(r["x"] for r in kept if r["perm"] == k) == sorted(values.tolist()) for k in (1, 2, 3))


def test_null_rows_are_shuffled_once(spark):
    field, spec = field_of(spark, [float(v) for v in RNG.random(64)], 8)
    plan = lambda n: permutation.local_test(field, spec, nperm=5, validate=False, broadcast_cells=n)._jdf.queryExecution().executedPlan().toString()
    assert plan(10).split("MapInArrow")[0].count("Window") == 0 and plan(1000).count("Window") == 0 and plan(1000).count("MapInArrow") == 0

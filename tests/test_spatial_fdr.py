import math

import numpy as np
import pytest
from helpers import by_cell, field_of, pvalues_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import fdr, permutation, spatial, tiles
from gridloom.operators.direction import direction_map, robust_range

EXAMPLE = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]


@pytest.mark.parametrize("values,nrow,connectivity,want", [([1, 10, 10, 1], 2, "queen", -1 / 3), ([1, 10, 10, 1], 2, "rook", -1), ([1, 1, 10, 10], 1, "queen", 1 / 3)])
def test_moran(spark, values, nrow, connectivity, want):
    field, spec = field_of(spark, values, nrow)
    assert spatial.global_statistic(field, spec, connectivity=connectivity).first()["statistic"] == pytest.approx(want)


def test_getis_ord(spark):
    field, spec = field_of(spark, [1, 10, 10, 1], 2)
    assert spatial.global_statistic(field, spec, method="getis_ord").first()["statistic"] == pytest.approx(1)
    field, spec = field_of(spark, [1, 2, 7], 1)
    assert by_cell(spatial.local_statistic(field, spec, method="getis_ord", connectivity="rook"), "statistic") == pytest.approx({1: 0.3, 2: 1.0, 3: 0.9})


def test_local_sums_to_global(spark):
    field, spec = field_of(spark, [1, 2, 4, 3, 6, 8, 5, 7, 9], 3)
    local = by_cell(spatial.local_statistic(field, spec, connectivity="rook"), "statistic")
    whole = spatial.global_statistic(field, spec, connectivity="rook").first()
    assert sum(local.values()) == pytest.approx(whole["s0"] * whole["statistic"])


def test_neighbourhood_shapes(spark):
    _, spec = field_of(spark, list(range(49)), 7)
    assert len(spatial.neighbourhood(spec, "queen", 5).offsets) == 24 and len(spatial.neighbourhood(spec, "rook", 5).offsets) == 8
    with pytest.raises(ValueError):
        spatial.neighbourhood(spec, "queen", 4)
    with pytest.raises(ValueError):
        spatial.neighbourhood(spec, "queen", 3).check(spec, "rook", 3)


def test_focal_median_keeps_missing_cells_missing(spark):
    field, spec = field_of(spark, [1, 2, None, 9], 2)
    assert by_cell(spatial.focal_median(field, "x", spec), "x") == {1: 2, 2: 2, 3: None, 4: 2}


def test_field_guards(spark):
    for values, method in (([1, 1, 1, 1], "moran"), ([1, None, None, 2], "moran"), ([0, 0, 0, 0], "getis_ord"), ([-1, 2, 3, 4], "getis_ord"), ([1, 2, math.inf, 3], "moran")):
        field, _ = field_of(spark, values, 2)
        with pytest.raises(ValueError):
            spatial.check_field(field, "x", method)


def test_permutations_shuffle_and_repeat(spark):
    field, spec = field_of(spark, [3, 1, 4, 1, None, 9, 2, 6, 5], 3)
    rows = permutation.permuted(field, "x", 5, 1).collect()
    for k in range(1, 6):
        assert sorted(r["x"] for r in rows if r["perm"] == k) == [1, 1, 2, 3, 4, 5, 6, 9]
    assert sorted(rows) == sorted(permutation.permuted(field, "x", 5, 1).collect())


def test_permutation_tests(spark):
    ramp = [i // 6 + i % 6 for i in range(36)]
    field, spec = field_of(spark, ramp, 6)
    r = permutation.global_test(field, spec, nperm=19).first()
    assert r["p"] == pytest.approx(0.05) and r["z"] > 2 and r["magnitude"] == "strong"
    assert permutation.global_test(field, spec, nperm=19, alternative="less").first()["p"] == pytest.approx(1)
    local = permutation.local_test(field, spec, nperm=19).collect()
    assert len(local) == 36 and all(0.05 <= x["p"] <= 1 for x in local)
    null = permutation.null_statistics(field, spec, "x", "moran", 19, 1)
    assert sum(x["n"] for x in permutation.null_histogram(null).collect()) == 19


def brute_bh(p):
    m, order, out, low = len(p), np.argsort(p)[::-1], np.zeros(len(p)), 1.0
    for k, i in enumerate(order):
        low = min(low, p[i] * m / (m - k))
        out[i] = low
    return out


def test_bky_example(spark):
    rows = fdr.correct(pvalues_of(spark, EXAMPLE), ("BH", "BY", "BKY"), 0.05).collect()
    assert sum(r["reject_BKY"] for r in rows) == 8
    got = {r["id"]: r["q_BH"] for r in rows}
    assert [got[i] for i in range(15)] == pytest.approx(list(brute_bh(np.array(EXAMPLE))))
    one = fdr.adjusted(pvalues_of(spark, EXAMPLE), "BKY", 0.05).first()
    assert one["m0"] == 11
    first = fdr.apply(pvalues_of(spark, EXAMPLE), "BKY", 0.05, "original").collect()
    assert sum(r["reject"] for r in first) <= 8 and all(r["q_value"] is None for r in first)


def test_fdr_extremes_and_missing(spark):
    none = fdr.apply(pvalues_of(spark, [0.6, 0.7, 0.8, 0.9, 0.95]), "BKY", 0.05, "original").collect()
    every = fdr.apply(pvalues_of(spark, [0.0001, 0.0002, 0.0003, 0.0004, 0.0005]), "BKY", 0.05, "original").collect()
    assert not any(r["reject"] for r in none) and all(r["reject"] for r in every)
    rows = {r["id"]: r["q_BH"] for r in fdr.correct(pvalues_of(spark, [0.01, None, 0.2, 0.5, float("nan")])).collect()}
    assert rows[1] is None and rows[4] is None and rows[0] == pytest.approx(0.03)
    for bad in ([None, None], [0.1, 1.2], [-0.1, 0.5]):
        with pytest.raises(ValueError):
            fdr.correct(pvalues_of(spark, bad))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1e-9, 1e-4, 0.001, 0.01, 0.0101, 0.2, 0.5, 0.9, 1.0]), min_size=1, max_size=30))
def test_adjusted_values_need_no_global_sort(spark, p):
    got = {r["id"]: r["q_value"] for r in fdr.apply(pvalues_of(spark, p), "BH").collect()}
    assert [got[i] for i in range(len(p))] == pytest.approx(list(brute_bh(np.array(p))))


def test_directions(spark):
    rows = spark.createDataFrame([("g", 1, True, 2.0), ("g", 2, True, -1.0), ("g", 3, False, 1.0), ("g", 4, None, 1.0), ("g", 5, True, None)], "grid_id string, cell long, reject_BH boolean, slope double")
    assert by_cell(direction_map(rows, ("BH",)), "direction_BH") == {1: 1, 2: -1, 3: 0, 4: None, 5: None}
    r = robust_range(rows.where("slope is null"), "slope").first()
    assert (r["lower"], r["upper"]) == (-1, 1)


def test_tiles_do_not_change_sums(spark, monkeypatch):
    values = [float((i * 37) % 11) for i in range(9 * 7)]
    cells, spec = field_of(spark, values, 9)
    got = {}
    for tile in (32, 3, 1):
        monkeypatch.setattr(tiles, "TILE", tile)
        for connectivity, window in (("queen", 3), ("rook", 5)):
            rows = spatial.lagged(cells, spec, connectivity, window, "x").withColumn("x", F.col("wz") + F.col("z")).collect()
            got.setdefault((connectivity, window), set()).add(tuple(sorted((r["cell"], r["x"]) for r in rows)))
    want = tuple((r * 7 + c + 1, sum(values[i * 7 + j] for i in range(max(0, r - 1), min(9, r + 2)) for j in range(max(0, c - 1), min(7, c + 2)))) for r in range(9) for c in range(7))
    assert got["queen", 3] == {want} and len(got["rook", 5]) == 1


def test_neighbour_sums_shuffle_once(spark):
    cells, spec = field_of(spark, [float(i) for i in range(64)], 8)
    sums = spatial.lagged(cells, spec, value="x")
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

"""Polygons against an even-odd test cell by cell, and histograms over the range of the values."""

import numpy as np
import pytest
from helpers import by_cell, field_of, stack_of
from pyspark.sql import functions as F

from gridloom.operators import inspect, prewhiten, report, slope, spatial, topology, trend
from gridloom.operators.grid import GridSpec

RINGS = "polygon string, ring array<struct<x:double,y:double>>"
RNG = np.random.default_rng(21)


def covered(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y < y2 or y2 <= y < y1) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def cells_of(spark, spec, rings, extent=None):
    rows = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in ring]) for k, some in rings.items() for ring in some], RINGS)
    spans = inspect.polygon_spans(spec, rows, extent).collect()
    return {k: {(r["row"], c) for r in spans if r["polygon"] == k for c in range(r["first"], r["last"] + 1)} for k in rings}


def test_spans_equal_the_even_odd_rule(spark):
    spec = GridSpec(12, 17, 2)
    rings = {"random": [RNG.uniform(-2, 18, (7, 2)).tolist()], "hole": [[(1, 1), (15, 1), (15, 11), (1, 11)], [(4, 4), (4, 8), (9, 8), (9, 4)]], "crossing": [[(0, 0), (16, 12), (16, 0), (0, 12)]], "outside": [[(30, 30), (40, 30), (40, 40)]], "on centres": [[(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5)]]}
    got = cells_of(spark, spec, rings)
    for name, some in rings.items():
        want = {(r, c) for r in range(1, 13) for c in range(1, 18) if covered(some, c - 0.5, r - 0.5)}
        assert got[name] == want, name
    assert got["on centres"] and not got["outside"]


def test_small_polygons_have_the_cells_they_touch(spark):
    spec = GridSpec(5, 5, 2)
    got = cells_of(spark, spec, {"in one": [[(2.6, 1.7), (2.9, 1.7), (2.9, 1.9)]], "over a border": [[(1.9, 2.6), (2.1, 2.6), (2.1, 2.8)]], "flat": [[(0.2, 0.7), (3.3, 0.7)]]})
    assert got == {"in one": {(2, 3)}, "over a border": {(3, 2), (3, 3)}, "flat": {(1, 1), (1, 2), (1, 3), (1, 4)}}


def test_extent_and_medians(spark):
    nrow, ncol = 6, 4
    series = RNG.normal(size=(nrow * ncol, 3))
    series[5, 1] = np.nan
    stack = stack_of(spark, [[None if np.isnan(v) else v for v in s] for s in series], nrow)
    extent = inspect.Extent(100.0, 108.0, 10.0, 22.0)  # cells are 2 x 2, row 1 on top
    rings = spark.createDataFrame([("p", [(100.5, 21.5), (105.5, 21.5), (105.5, 16.5), (100.5, 16.5)])], RINGS)
    got = {r["t"]: r["value"] for r in inspect.polygon_series(stack, rings, extent).collect()}
    inside = [r * ncol + c for r in range(3) for c in range(3)]
    inside = [i for i in inside if covered([[(100.5, 21.5), (105.5, 21.5), (105.5, 16.5), (100.5, 16.5)]], 101 + 2 * (i % ncol), 21 - 2 * (i // ncol))]
    assert len(inside) == 9 and 5 in inside
    assert got == {t + 1: pytest.approx(np.nanmedian(series[inside, t])) for t in range(3)}
    two = rings.union(rings.select(F.lit("q").alias("polygon"), "ring"))
    assert inspect.polygon_series(stack, two, extent).count() == 6


def test_histograms_hold_every_value(spark):
    stack = stack_of(spark, [RNG.normal(size=24) + 0.1 * np.arange(24) for _ in range(30)] + [[1.0] * 24])
    made = report.slope_histogram(slope.slope_estimator(stack), bins=7).collect()
    assert sum(r["n"] for r in made) == 31 and {r["panel"] for r in made} == {"slope"} and all(r["lower"] < r["upper"] for r in made)
    assert {r["panel"] for r in report.statistic_histogram(trend.trend_test(stack, "OLS")).collect()} == {"beta"}
    _, d = prewhiten.prewhiten(stack, "VCTFPW")
    panels = report.prewhiten_histograms(d).groupBy("panel").agg(F.sum("n").alias("n")).collect()
    changed = d.where("Modified = 1").count()
    assert {r["panel"]: r["n"] for r in panels} == ({"Rho": changed, "Beta_corrected": changed} if changed else {})
    _, d = prewhiten.prewhiten(stack, "TFPW_Y")
    assert {r["panel"]: r["n"] for r in report.prewhiten_histograms(d).groupBy("panel").agg(F.sum("n").alias("n")).collect()} == {"Rho": 30, "Beta_TheilSen": 31}
    flat = report.range_histogram(spark.createDataFrame([("g", 2.0), ("g", 2.0), ("g", None)], "grid_id string, v double"), "v").collect()
    assert [(r["bin"], r["lower"], r["upper"], r["n"]) for r in flat] == [(1, 2.0, 2.0, 2)]


def test_a_topology_is_for_its_mask(spark):
    values = [float(v) for v in RNG.normal(size=35)]
    field, spec = field_of(spark, [None if i % 9 == 4 else v for i, v in enumerate(values)], 5)
    made = topology.prepare(field, spec, valid="x is not null")
    want = by_cell(spatial.lagged(field.where("x is not null"), spec, value="x"), "k")
    assert by_cell(made.cells, "k") == want and made.masks.first()["s0"] == sum(want.values())
    assert by_cell(topology.local_statistic(made, field.repartition(5), spec), "statistic") == pytest.approx(by_cell(spatial.local_statistic(field, spec), "statistic"), nan_ok=True)
    assert topology.global_statistic(made, field, spec, method="moran").first()["statistic"] == pytest.approx(spatial.global_statistic(field, spec).first()["statistic"])
    plan = topology.with_neighbours(made, made.cells.drop("k"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    other, _ = field_of(spark, [None if i % 9 == 3 else v for i, v in enumerate(values)], 5)
    for bad in (lambda: topology.local_statistic(made, other, spec), lambda: topology.global_statistic(made, field.where("cell > 1"), spec), lambda: topology.local_statistic(made, field, GridSpec(7, 5, 1)), lambda: topology.local_statistic(made, field.withColumn("grid_id", F.lit("h")), spec)):
        with pytest.raises(ValueError):
            bad()
    stack = stack_of(spark, [[None if i % 9 == 4 else v + t * 0.1 * (i % 3) for t in range(6)] for i, v in enumerate(values)], 5)
    alone = by_cell(trend.trend_test(stack, "CMK"), "p")
    assert by_cell(trend.trend_test(stack, "CMK", precomputed=made), "p") == alone
    with pytest.raises(ValueError):
        trend.trend_test(stack_of(spark, [[v, v + 1, v] for v in values], 5), "CMK", precomputed=made)

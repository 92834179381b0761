import math
from datetime import date

import numpy as np
import pytest
from helpers import stack_of
from pyspark.sql import functions as F

from gridloom.functions import dist, validate
from gridloom.operators import benchmark, inspect, report, scoring, simulate, trend
from gridloom.plans.workflows import workflow_rta, workflow_trends, workflow_tst
from gridloom.sources import calendar, readers, sinks


def scored(spark, significant, truth, direction=None, true_direction=None, wanted=scoring.METRICS):
    n = len(truth)
    det = spark.createDataFrame([("m", i, significant[i], (direction or [None] * n)[i]) for i in range(n)], "method string, cell long, significant boolean, direction int")
    tru = spark.createDataFrame([(i, truth[i], (true_direction or [None] * n)[i]) for i in range(n)], "cell long, signal boolean, direction int")
    return scoring.compare_detections(det, tru, wanted).first()


def test_scores(spark):
    r = scored(spark, [False] * 6, [True, True, False, False, True, False])
    assert (r["TP"], r["FN"], r["Precision"], r["FDR"]) == (0, 3, None, 0)
    r = scored(spark, [True] * 4 + [False] * 2, [True] * 3 + [False] * 3)
    assert r["Accuracy"] == pytest.approx(5 / 6) and r["MCC"] == pytest.approx(6 / math.sqrt(72))
    r = scored(spark, [True, True, False, True, False, False], [True] * 3 + [False] * 3, [1, -1, 0, 1, 0, 0], [1, 1, -1, 0, 0, 0])
    assert [r[k] for k in ("TypeI", "TypeII", "TypeIII", "WithinImagePower", "DirectionalPower")] == pytest.approx([1 / 3, 1 / 3, 1 / 2, 2 / 3, 1 / 3])


def test_masks_replicates_and_best(spark):
    det = spark.createDataFrame([(m, k, c, (c + k) % d == 0) for m, d in (("a", 2), ("b", 3)) for k in (1, 2) for c in range(12)], "method string, replicate int, cell long, significant boolean")
    truth = spark.createDataFrame([(c, c % 2 == 0) for c in range(12)], "cell long, signal boolean")
    mask = spark.createDataFrame([(c, c < 6) for c in range(12)], "cell long, mask boolean")
    rows = {r["method"]: r for r in scoring.compare_detections(det, truth, ("FPR", "Sensitivity"), mask).collect()}
    assert rows["a"]["n_replicates"] == 2 and rows["a"]["FWER"] == 0.5 and rows["a"]["Sensitivity_mean"] == 0.5
    best = scoring.best_methods(spark.createDataFrame([("a", 0.2, 0.9), ("b", 0.1, 0.9)], "method string, FPR double, Accuracy double"), ("FPR", "Accuracy")).collect()
    assert {(r["metric"], r["method"]) for r in best} == {("FPR", "b"), ("Accuracy", "a")}


def test_distributions():
    assert dist.normal_quantile(0.975) == pytest.approx(dist.Z_975)
    assert dist.t_quantile(0.975, 26) == pytest.approx(2.0555294386428731, rel=1e-9)
    assert dist.bessel_k(0.5, np.array([1.0]))[0] == pytest.approx(math.sqrt(math.pi / 2) * math.exp(-1), rel=1e-8)


@pytest.mark.parametrize("df", [1, 2, 5, 26])
def test_distribution_expressions(spark, df):
    xs = [0.0, 0.3, 1.0, 2.5, 6.0, 7.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(dist.normal_two_sided_sql("x")).alias("n"), F.expr(dist.t_two_sided_sql("x", df)).alias("t"), trend.normal_p(F.col("x")).alias("m")).collect()
    for r in rows:
        assert r["n"] == pytest.approx(math.erfc(r["x"] / math.sqrt(2)), rel=1e-9) and r["m"] == r["n"]
        assert r["t"] == pytest.approx(2 * (1 - dist.t_cdf(r["x"], df)), abs=1e-12)


def test_validators():
    assert validate.time_axis([1, 2.5, 4], 3) == [1, 2.5, 4]
    for f, bad in ((lambda x: validate.time_axis(x, 2), [2, 1]), (lambda x: validate.positive_integer(x, "n"), 0), (validate.odd_window, 4), (lambda x: validate.probability(x, "p"), 1), (validate.seed, math.inf), (validate.max_pairs, 0.5)):
        with pytest.raises(ValueError):
            f(bad)
    with pytest.raises(ValueError):
        validate.extra_arguments({"method": "x"}, ("method",), "args")
    assert validate.max_pairs(math.inf) == math.inf and validate.reference_alpha([0.1, 0.05]) == 0.05 and validate.reference_alpha([0.1, 0.2]) == 0.1


def test_calendars(spark):
    assert calendar.calendar_dates("semimonthly", date(2020, 2, 1), 2, anchor="end")[1] == date(2020, 2, 29)
    assert calendar.calendar_dates("10-day", date(1982, 1, 1), 1)[0] == date(1982, 1, 5)
    assert calendar.periods("weekly", date(2001, 1, 1), 53)[51] == (date(2001, 12, 24), date(2001, 12, 30))
    assert calendar.periods("weekly", date(2001, 1, 1), 53)[52][0] == date(2002, 1, 1)
    for cycle, start in (("monthly", date(2020, 1, 2)), ("8-day", date(2020, 1, 3))):
        with pytest.raises(ValueError):
            calendar.periods(cycle, start, 1)
    with pytest.raises(ValueError):
        calendar.calendar_dates("annual", date(2020, 1, 1), 2, end=date(2022, 12, 31))
    for cycle in calendar.CYCLES:
        rows = sorted((r["start"], r["end"]) for r in calendar.calendar_frame(spark, cycle, date(2019, 1, 1), date(2020, 12, 31)).collect())
        assert rows == calendar.periods(cycle, date(2019, 1, 1), len(rows))


def test_orders_and_names():
    assert readers.order_of(["b_10.parquet", "a_2.parquet"])[0] == [0, 1]  # greedy: the last digits, 0 and 2
    assert readers.order_of(["b_year10.parquet", "a_year2.parquet"])[0] == [1, 0]
    assert readers.order_of(["b_2010.parquet", "a_1999.parquet"])[0] == [1, 0]
    assert readers.order_of(["x1_2003.csv", "x1_2001.csv", "x1_2002.csv"])[1] == [2001, 2002, 2003]
    for bad in (["a", "b"], [], ["a_1", "b_1"]):
        with pytest.raises(ValueError):
            readers.order_of(bad)
    assert readers.unique_names(["a", "a", "b", "a_1", "a"]) == ["a", "a_2", "b", "a_1", "a_3"]


def test_reading_stacks(spark, tmp_path):
    for k in (2010, 2002):
        spark.createDataFrame([(r, c, float(k)) for r in (1, 2) for c in (1, 2)], "row int, col int, value double").coalesce(1).write.parquet(str(tmp_path / f"l_{k}.parquet"))
    got = readers.read_ordered_stack(spark, directory=str(tmp_path))
    assert {(r["t"], r["value"]) for r in got.values.collect()} == {(1, 2002.0), (2, 2010.0)} and got.n == 2
    files = [str(tmp_path / "l_2010.parquet"), str(tmp_path / "l_2002.parquet")]
    got = readers.read_ordered_stack(spark, files=files, cycle_type="monthly", start=date(2020, 1, 1))
    assert {(r["t"], r["value"]) for r in got.values.collect()} == {(1, 2010.0), (2, 2002.0)}
    for bad in ({}, {"directory": str(tmp_path), "files": files}, {"files": files, "time": [2, 1]}, {"files": files, "cycle_type": "monthly"}, {"files": files, "start": date(2020, 1, 1)}, {"directory": str(tmp_path), "time": [1, 2]}, {"files": [*files, files[0]]}, {"files": ["/nowhere"]}):
        with pytest.raises(ValueError):
            readers.read_ordered_stack(spark, **bad)


def test_cubes(spark):
    cube = spark.createDataFrame([(date(2020, 3, 1), 1, 1, 3.0), (date(2020, 1, 1), 1, 1, 1.0)], "time date, row int, col int, v double")
    long = readers.long_from_cubes(cube)
    assert {(r["t"], r["value"]) for r in long.collect()} == {(1, 1.0), (2, 3.0)}
    with pytest.warns(UserWarning):
        assert readers.sub_annual(long)
    for bad in (cube.union(cube), cube.withColumn("w", F.lit(1.0)), cube.withColumn("time", F.lit(None).cast("date"))):
        with pytest.raises(ValueError):
            readers.long_from_cubes(bad)
    assert readers.example_data() == ["ramp"] and len(readers.example_data("ramp")) == 45


def test_simulation(spark):
    s = simulate.Scenario(nrow=6, ncol=6, n_time=10, noise_sd=0.0, break_type="mean", break_time=5, break_magnitude=3.0, break_fraction=1.0, trend_strength=0.0, constant_block=False)
    sim = simulate.simulate(spark, s)
    rows = {(r["cell"], r["t"]): r["value"] for r in sim.long.collect()}
    assert all(rows[c, 6] - rows[c, 5] == 3 and rows[c, 5] == 10 for c in range(1, 37))
    sim = simulate.simulate(spark, simulate.Scenario(nrow=8, ncol=8, n_time=6))
    corner = {r["value"] for r in sim.long.where("cell in (1, 2, 9, 10)").collect()}
    assert corner == {5.0} and report.simulation_summary(sim.truth).first()["DomainCells"] == 64
    assert sorted(sim.long.collect()) == sorted(simulate.simulate(spark, sim.scenario).long.collect())


def test_noise_moments(spark):
    s = simulate.Scenario(nrow=25, ncol=25, n_time=40, ar1=0.7, noise_sd=2.0, smooth_radius=0, seed=5)
    x = np.array([r["v"] for r in simulate.noise(spark, s, 1).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("t", "noise"))).alias("s")).select(F.col("s.noise").alias("v")).collect()])
    assert x.std() == pytest.approx(2, abs=0.1) and np.corrcoef(x[:, 1:].ravel(), x[:, :-1].ravel())[0, 1] == pytest.approx(0.7, abs=0.03)
    for model, rho in (("exponential", 0.65), ("gaussian", 0.65)):
        s = simulate.Scenario(nrow=24, ncol=24, n_time=30, spatial_model=model, spatial_rho=rho, ar1=0.0)
        e = simulate.innovations(spark, s, 1).toPandas().pivot(index="t", columns="cell", values="e").to_numpy().reshape(30, 24, 24)
        assert np.corrcoef(e[:, :, 1:].ravel(), e[:, :, :-1].ravel())[0, 1] == pytest.approx(rho, abs=0.05) and e.std() == pytest.approx(1, abs=0.1)


def test_matern_matches_the_exponential():
    d = np.array([0.0, 1.0, 2.0])
    assert simulate.correlation("matern", d, 1, 2.0, 0.5) == pytest.approx(np.exp(-d / 2), rel=1e-6)


def test_design_and_benchmark(spark):
    design = simulate.simulation_design(spark, {"trend_strength": [0.0, 2.0], "ar1": [0.0]}, {"nrow": 6, "ncol": 6, "n_time": 10, "smooth_radius": 0})
    assert [(r["scenario"], r["trend_strength"]) for r in design.orderBy("scenario").collect()] == [("S01", 0.0), ("S02", 2.0)]
    methods = {"MK": lambda stack, sim: trend.trend_test(stack, "MK").select("grid_id", "cell", (F.col("p") <= 0.05).alias("significant"))}
    rows = benchmark.benchmark_methods(spark, dict(simulate.scenarios_of(design)), methods, 2, "fwer")
    assert rows.count() == 4 and set(benchmark.KEYS) <= set(rows.columns)
    table = {r["Scenario"]: r for r in benchmark.benchmark_summary(rows).collect()}
    assert table["S01"]["Pi0_mean"] == 1 and table["S02"]["n_replicates"] == 2 and table["S02"]["Sensitivity_mean"] > 0.5
    plot = benchmark.benchmark_plot_table(rows, "EmpiricalFWER", "ci").collect()
    assert all(0 <= r["lower"] <= r["mean"] <= r["upper"] <= 1 for r in plot)
    white = {"none": lambda stack, sim: stack.cells.select("grid_id", "cell", "y")}
    assert benchmark.benchmark_methods(spark, {"x": simulate.Scenario(nrow=5, ncol=5)}, white, 1, "prewhitening").first()["OutputLength"] == 10


def test_workflows(spark, tmp_path):
    sim = simulate.simulate(spark, simulate.Scenario(nrow=8, ncol=8, n_time=20, trend_strength=0.8, ar1=0.4))
    from gridloom.operators.grid import to_stack

    stack = to_stack(sim.long, sim.scenario.spec)
    for out in (workflow_tst(stack, moran_check=True), workflow_rta(stack)):
        assert out.cells.count() == 64
        tables = out.summary()
        assert tables["trend"].first()["n_valid"] == 64 and tables["direction"].first()["n_valid"] == 64
        for view in ("statistic", "direction", "p_histogram", "masked_slope", "slope_range", "threshold"):
            assert out.plot_data(view).count() > 0
        sinks.write_csv(tables["trend"], str(tmp_path / out.kind))
    assert spark.read.csv(str(tmp_path / "rta"), header=True).count() == 1
    with pytest.warns(UserWarning):
        workflow_trends(stack, "VCTFPW", "MMK", None, None)
    with pytest.raises(ValueError):
        workflow_trends(stack, trend_args={"method": "MK"})


def test_inspection(spark):
    stack = stack_of(spark, [[c + 0.5 * t for t in range(1, 9)] for c in range(9)], nrow=3)
    assert inspect.neighbours_of(stack, 1) == [1, 2, 4, 5] and len(inspect.neighbours_of(stack, 5)) == 9
    rows = inspect.inspect_cell(stack, 5, aggregate=True).collect()
    assert {r["method"] for r in rows} == {"TS", "OLS", "RM"} and all(r["slope"] == pytest.approx(0.5) for r in rows)
    fits = inspect.small_multiples(stack, 1)
    assert fits.count() == 12 and inspect.panel(stack, 1, fits).count() == 24


def test_scores_without_and_with_only_false_discoveries(spark):
    rows = spark.createDataFrame([(m, c, c > 2 if m == "false" else False) for m in ("none", "false") for c in range(5)], "method string, cell long, significant boolean")
    truth = spark.createDataFrame([(c, c <= 2) for c in range(5)], "cell long, signal boolean")
    got = {r["method"]: r for r in scoring.compare_detections(rows, truth).collect()}
    assert (got["none"]["Precision"], got["none"]["F1"], got["none"]["Sensitivity"], got["none"]["FDR"]) == (None, None, 0, 0)
    assert (got["false"]["Precision"], got["false"]["F1"], got["false"]["FDR"], got["false"]["FPR"]) == (0, None, 1, 1)
    with pytest.raises(ValueError, match="FWER"):
        scoring.compare_detections(rows, truth, ("FDR", "FWER"))


def test_durbin_watson_bounds():
    from gridloom.operators.prewhiten import dw_critical_values

    assert dw_critical_values(15) == (1.077, 1.361) and dw_critical_values(28) == (1.328, 1.476) and dw_critical_values(100) == (1.654, 1.694)
    assert dw_critical_values(10) == (1.077, 1.361) and dw_critical_values(42) == pytest.approx((1.4552, 1.5528)) and dw_critical_values(500) == (1.654, 1.694)


def test_t_values_of_normal_scores():
    z = {1e-12: -7.034483825301131, 1e-4: -3.719016485455709, 2e-4: -3.540083799206145, 0.3: -0.5244005127080407}
    for df in (2.5, 4.0, 30.0):
        for p, x in z.items():
            assert simulate.t_of_normal(np.array([x, -x]), df) == pytest.approx([dist.t_quantile(p, df), -dist.t_quantile(p, df)], rel=2e-4)


def test_evaluators_return_one_row_for_each_replicate(spark):
    twice = lambda result, sim: result.select("grid_id").union(result.select("grid_id"))
    with pytest.raises(ValueError, match="one row"):
        benchmark.benchmark_methods(spark, {"a": simulate.Scenario(nrow=4, ncol=4, n_time=6, constant_block=False)}, {"m": lambda stack, sim: stack.cells}, 1, "custom", evaluator=twice)


def test_prewhitening_scores_name_their_columns(spark):
    rows = spark.createDataFrame([("1", 1, [1.0, 3.0, 2.0, 5.0], 1), ("1", 2, [1.0, 2.0, 3.0, 4.5], 0)], "grid_id string, cell long, y array<double>, Modified int")
    truth = spark.createDataFrame([("1", 1, 1.0), ("1", 2, 1.0)], "grid_id string, cell long, true_slope double")
    got = benchmark.prewhitening_scores(rows, truth)
    assert set(got.columns) == {"grid_id", "ResidualACF1", "AbsResidualACF1", "SlopeBias", "SlopeMAE", "SlopeRMSE", "ModifiedFraction", "OutputLength"}
    r = got.first()
    assert (r["ModifiedFraction"], r["OutputLength"]) == (0.5, 4.0) and r["SlopeBias"] == pytest.approx((0.1 + 0.15) / 2)
    with pytest.raises(ValueError, match="three layers"):
        benchmark.prewhitening_scores(rows.selectExpr("grid_id", "cell", "slice(y, 1, 2) as y"), truth)

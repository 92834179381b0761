"""Benchmarks of methods over simulated scenarios.

All replicates of a scenario are grids of one DataFrame, so a method runs once per scenario and Spark
spreads replicates and cells alike. ``Elapsed`` is therefore the time of a scenario's batch divided by its
replicates, and not that of one replicate measured alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dist import normal_quantile, t_quantile
from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice, positive_integer
from gridloom.operators import scoring
from gridloom.operators.grid import Stack, to_stack
from gridloom.operators.simulate import Scenario, Simulation, simulate
from gridloom.operators.slope import residual_autocorrelation

STAGES = ("trend_test", "fdr", "fwer", "slope", "prewhitening", "custom")
KEYS = ("Scenario", "Replicate", "Method")
RESERVED = (*KEYS, "Elapsed", "DomainCells", "TrueNulls", "Pi0", "SignalProportion")
ALIASES = {"EmpiricalFDR": "FDP", "EmpiricalFWER": "AnyFalsePositive"}

Method = Callable[[Stack, Simulation], DataFrame]


def score_stage(stage: str, result: DataFrame, sim: Simulation, stack: Stack, wanted: tuple[str, ...], evaluator=None, mask: DataFrame | None = None) -> DataFrame:
    """One row per replicate (grid_id) of what a method returned."""
    truth = sim.truth
    if mask is not None:
        truth = truth.join(mask.where("mask").select("cell"), "cell", "left_semi")
    if stage == "custom":
        scores = checkpointed(evaluator(result, sim))
        if "grid_id" not in scores.columns or not scores.groupBy("grid_id").count().where("count > 1").isEmpty():
            raise ValueError("an evaluator returns grid_id and one row for each")
        return scores
    if stage == "slope":
        return scoring.slope_scores(result.select("grid_id", "cell", "slope").join(truth, ["grid_id", "cell"]), ("grid_id",))
    if stage == "prewhitening":
        return prewhitening_scores(result, truth)
    rows = result.select("grid_id", "cell", "significant", *(["direction"] if "direction" in result.columns else []))
    rows = rows.join(truth.select("grid_id", "cell", (F.col("true_signal") == 1).alias("signal"), "true_direction"), ["grid_id", "cell"])
    out = scoring.metrics(scoring.confusion(rows, ("grid_id",)))
    names = list(wanted)
    if stage in ("fdr", "fwer"):
        found = F.col("TP") + F.col("FP")
        out = out.withColumn("FDP", F.when(found > 0, F.col("FP") / found).otherwise(F.lit(0.0))).withColumn("AnyFalsePositive", (F.col("FP") > 0).cast("double"))
        names += ["FDP", "AnyFalsePositive"]
    return out.select("grid_id", *names)


def prewhitening_scores(result: DataFrame, truth: DataFrame) -> DataFrame:
    """result: grid_id, cell, y (prewhitened) and optionally Modified. Residual correlation, slope errors, share modified, length.

    Series of fewer than three layers have no residual correlation and are refused.
    """
    result = checkpointed(result)
    least = result.agg(F.min(F.size("y"))).first()[0]
    if least is not None and least < 3:
        raise ValueError("prewhitening scores need three layers or more")
    size = F.size("y")
    long = result.where(F.col("y").isNotNull() & ~F.exists("y", lambda v: v.isNull())).select("grid_id", "cell", F.posexplode("y").alias("k", "value")).withColumn("t", F.col("k") + 1)
    fits = long.groupBy("grid_id", "cell").agg(F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("b"))
    rest = long.join(fits, ["grid_id", "cell"]).select("grid_id", "cell", "t", (F.col("value") - F.col("b") - F.col("slope") * F.col("t")).alias("value"))
    r = residual_autocorrelation(rest).groupBy("grid_id").agg(F.avg("r").alias("ResidualACF1"), F.avg(F.abs("r")).alias("AbsResidualACF1"))
    slopes = scoring.slope_scores(fits.join(truth, ["grid_id", "cell"]), ("grid_id",)).select("grid_id", F.col("Bias").alias("SlopeBias"), F.col("MAE").alias("SlopeMAE"), F.col("RMSE").alias("SlopeRMSE"))
    changed = F.avg((F.col("Modified") != 0).cast("double")) if "Modified" in result.columns else F.lit(None).cast("double")
    other = result.groupBy("grid_id").agg(F.max(size).cast("double").alias("OutputLength"), changed.alias("ModifiedFraction"))
    return r.join(slopes, "grid_id", "full").join(other, "grid_id", "full")


def scenario_columns(name: str, s: Scenario) -> dict[str, object]:
    """Scalars as they are, tuples as text, nothing for what is not set."""
    return {"Scenario": name} | {k: ",".join(map(str, v)) if isinstance(v, tuple) else v for k, v in asdict(s).items() if v is not None and v != () and k != "custom_mask"}


def benchmark_methods(
    spark: SparkSession, scenarios: Mapping[str, Scenario], methods: Mapping[str, Method], n_replicates: int = 10, stage: str = "trend_test",
    simulator: Callable[..., Simulation] = simulate, prepare: Callable[[Stack], Stack] | None = None, evaluator=None,
    wanted: tuple[str, ...] = scoring.DEFAULT, evaluation_mask: DataFrame | None = None,
) -> DataFrame:
    """One row per scenario, replicate and method: the scores, Elapsed, the scenario's settings and its true proportions.

    Methods see the same realisations. They take (stack, simulation) and return what score_stage expects; a custom
    evaluator takes (result, simulation) and returns one row per grid_id.
    """
    choice(stage, STAGES, "stage")
    positive_integer(n_replicates, "n_replicates")
    if not scenarios or not methods:
        raise ValueError("there must be scenarios and methods")
    if stage == "custom" and evaluator is None:
        raise ValueError("a custom stage needs an evaluator")
    out = None
    for name, s in scenarios.items():
        sim = simulator(spark, s, n_replicates)
        sim = Simulation(sim.long.persist(), sim.truth.persist(), s)
        stack = to_stack(sim.long, s.spec)
        stack = prepare(stack) if prepare else stack
        stack = Stack(stack.cells.persist(), stack.spec)
        domain = sim.truth.groupBy("grid_id").agg(F.count("*").alias("DomainCells"), F.count_if(F.col("true_signal") == 0).alias("TrueNulls"))
        domain = domain.withColumn("Pi0", F.col("TrueNulls") / F.col("DomainCells")).withColumn("SignalProportion", 1 - F.col("Pi0"))
        for method, run in methods.items():
            began = time.perf_counter()
            result = run(stack, sim).persist()
            result.count()
            elapsed = (time.perf_counter() - began) / n_replicates
            scores = score_stage(stage, result, sim, stack, wanted, evaluator, evaluation_mask)
            if clash := sorted(set(scores.columns) & set(RESERVED)):
                raise ValueError(f"scores use reserved names: {clash}")
            settings = {k: v for k, v in scenario_columns(name, s).items() if k not in scores.columns}
            rows = scores.join(domain, "grid_id").withColumnsRenamed({"grid_id": "Replicate"}).withColumns({"Method": F.lit(method), "Elapsed": F.lit(elapsed)} | {k: F.lit(v) for k, v in settings.items()})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def benchmark_summary(rows: DataFrame, factors: tuple[str, ...] = ()) -> DataFrame:
    """Per scenario, factors and method: mean and deviation of every number (no deviation from fewer than two values),
    EmpiricalFDR (mean false discovery proportion) and EmpiricalFWER (share of replicates with a false positive)."""
    keys = ["Scenario", *factors, "Method"]
    skip = {*keys, "Replicate", *Scenario.__dataclass_fields__}
    numbers = [c for c, kind in rows.dtypes if c not in skip and kind in ("double", "float", "int", "bigint")]
    aggregates = [f(c).alias(f"{c}_{n}") for c in numbers for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    for name, source in ALIASES.items():
        if source in rows.columns:
            aggregates.append(F.avg(source).alias(name))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_replicates"), *aggregates)


def benchmark_plot_table(rows: DataFrame, metric: str, error: str = "se", level: float = 0.95, rate: bool = True, by: tuple[str, ...] = ("Scenario", "Method")) -> DataFrame:
    """by, mean, lower, upper: the mean of a metric with its deviation, standard error or t interval; rates are kept in [0, 1]."""
    choice(error, ("sd", "se", "ci"), "error")
    metric = ALIASES.get(metric, metric)
    out = rows.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    half = F.col("sd") if error == "sd" else F.col("sd") / F.sqrt("n")
    if error == "ci":
        table = F.array(*(F.lit(t_quantile(0.5 + level / 2, df)) for df in range(1, 121)))
        z, df = normal_quantile(0.5 + level / 2), F.col("n") - 1
        many = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)  # error below 1e-7 from 121 degrees on
        half = half * F.when(F.col("n") > 121, many).when(F.col("n") > 1, F.get(table, (F.col("n") - 2).cast("int")))
    half = F.coalesce(half, F.lit(0.0))
    low, high = F.col("mean") - half, F.col("mean") + half
    if rate:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return out.select(*by, "n", "mean", low.alias("lower"), high.alias("upper"))


def benchmark_boxes(rows: DataFrame, metric: str, by: tuple[str, ...] = ("Scenario", "Method")) -> DataFrame:
    """Five numbers of a metric per group."""
    x = F.col(ALIASES.get(metric, metric))
    return rows.groupBy(*by).agg(*(F.percentile(x, F.lit(p)).alias(n) for n, p in (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))))


def benchmark_heatmap(rows: DataFrame, metric: str, x: str, y: str) -> DataFrame:
    """x, y, method and the metric's mean."""
    return rows.groupBy(x, y, "Method").agg(F.avg(ALIASES.get(metric, metric)).alias("mean"))

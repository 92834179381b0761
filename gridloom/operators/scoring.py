"""Scores of detections against known truth: one conditional aggregate, whatever the number of replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = (
    "Sensitivity", "Specificity", "Precision", "Accuracy", "F1", "MCC", "FPR", "FDR", "TypeI", "TypeII", "TypeIII",
    "FieldPower", "GlobalPower", "WithinImagePower", "DirectionalPower",
)
DEFAULT = ("Sensitivity", "Specificity", "Precision", "Accuracy", "F1", "MCC", "FPR", "FDR")
LOWER_IS_BETTER = ("FPR", "FDR", "TypeI", "TypeII", "TypeIII", "FWER")


def _div(a: Column, b: Column) -> Column:
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def confusion(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows: by, significant, signal, and optionally direction, true_direction. Counts over rows where both are known."""
    d = F.col("direction") if "direction" in rows.columns else F.lit(None).cast("int")
    td = F.col("true_direction") if "true_direction" in rows.columns else F.lit(None).cast("int")
    rows = rows.where(F.col("significant").isNotNull() & F.col("signal").isNotNull()).withColumn("__d", d).withColumn("__td", td)
    s, g = F.col("significant"), F.col("signal")
    directed = F.col("__d").isNotNull() & F.col("__td").isNotNull()
    right = s & g & directed & (F.signum("__d") == F.signum("__td"))
    wrong = s & g & directed & (F.signum("__d") != F.signum("__td"))
    return rows.groupBy(*by).agg(
        F.count_if(s & g).alias("TP"), F.count_if(s & ~g).alias("FP"), F.count_if(~s & ~g).alias("TN"), F.count_if(~s & g).alias("FN"),
        F.count_if(right).alias("right"), F.count_if(wrong).alias("wrong"), F.count_if(directed).alias("directed"))


def metrics(counts: DataFrame) -> DataFrame:
    """All metrics of METRICS from the counts; null where the denominator is 0. FDR is 0 without discoveries."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    directed = F.col("directed") > 0
    f1 = F.when(precision + recall != 0, 2 * precision * recall / (precision + recall))  # null too where either is null
    out = {
        "Sensitivity": recall, "Specificity": _div(tn, tn + fp), "Precision": precision, "Accuracy": _div(tp + tn, tp + fp + tn + fn),
        "F1": f1, "MCC": _div(tp * tn - fp * fn, root), "FPR": _div(fp, fp + tn),
        "FDR": F.when(tp + fp == 0, F.lit(0.0)).otherwise(_div(fp, tp + fp)), "TypeI": _div(fp, fp + tn), "TypeII": _div(fn, tp + fn),
        "TypeIII": F.when(directed, _div(F.col("wrong"), tp)), "FieldPower": (tp + fp > 0).cast("double"), "GlobalPower": (tp > 0).cast("double"),
        "WithinImagePower": recall, "DirectionalPower": F.when(directed, _div(F.col("right"), tp + fn)),
    }
    return counts.select("*", *(v.alias(k) for k, v in out.items()))


def joined(detections: DataFrame, truth: DataFrame, evaluation_mask: DataFrame | None = None) -> DataFrame:
    """detections (method, cell, [replicate], significant, [direction]) with truth (cell, [replicate], signal, [direction]).

    Truth and mask without a replicate hold for all replicates.
    """
    on = ["cell", *(["replicate"] if "replicate" in truth.columns and "replicate" in detections.columns else [])]
    named = truth.withColumnRenamed("direction", "true_direction") if "direction" in truth.columns else truth
    out = detections.join(named, on)
    if evaluation_mask is not None:
        on = ["cell", *(["replicate"] if "replicate" in evaluation_mask.columns and "replicate" in detections.columns else [])]
        out = out.join(evaluation_mask.where("mask").select(*on), on, "left_semi")
    return out


def compare_detections(detections: DataFrame, truth: DataFrame, wanted: tuple[str, ...] = DEFAULT, evaluation_mask: DataFrame | None = None) -> DataFrame:
    """One row per method: TP, FP, TN, FN and the wanted metrics. With a replicate column: see aggregate_replicates."""
    if unknown := set(wanted) - {*METRICS, "FWER"}:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    if "FWER" in wanted and "replicate" not in detections.columns:
        raise ValueError("FWER is a share of replicates; detections have none")
    wanted = tuple(c for c in wanted if c != "FWER")  # always among the columns of replicates
    rows = joined(detections, truth, evaluation_mask)
    if "replicate" in detections.columns:
        return aggregate_replicates(metrics(confusion(rows, ("method", "replicate"))), wanted)
    return metrics(confusion(rows, ("method",))).select("method", "TP", "FP", "TN", "FN", *wanted)


def aggregate_replicates(scores: DataFrame, wanted: tuple[str, ...] = DEFAULT) -> DataFrame:
    """Per method: mean and sample deviation of each metric over replicates, and FWER, the share with a false positive."""
    return scores.groupBy("method").agg(
        F.count("*").alias("n_replicates"), *(f(c).alias(f"{c}_{n}") for c in wanted for n, f in (("mean", F.avg), ("sd", F.stddev_samp))),
        F.avg((F.col("FP") > 0).cast("double")).alias("FWER"))


def best_methods(scores: DataFrame, names: tuple[str, ...], order: tuple[str, ...] | None = None) -> DataFrame:
    """metric, method, value: the best method for each metric; the first of ``order`` (else of the alphabet) wins ties."""
    cases = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(c.split("_")[0] in LOWER_IS_BETTER).alias("low")) for c in names))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method")) if order else F.col("method")
    rows = scores.select("method", place.alias("place"), F.explode(cases).alias("c")).select("method", "place", "c.*").where("value is not null")
    key = F.when(F.col("low"), F.col("value")).otherwise(-F.col("value"))
    first = F.row_number().over(Window.partitionBy("metric").orderBy(key, "place"))
    return rows.withColumn("n", first).where("n = 1").select("metric", "method", "value")


def detection_bars(scores: DataFrame, names: tuple[str, ...] = DEFAULT) -> DataFrame:
    """Plot-ready rows: method, metric, value."""
    return scores.unpivot(["method"], list(names), "metric", "value")


def slope_scores(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Bias, MAE, RMSE and DirectionError of ``slope`` against ``true_slope`` over pairs that are both finite."""
    e = F.col("slope") - F.col("true_slope")
    known = rows.where(F.col("slope").isNotNull() & ~F.isnan("slope") & F.col("true_slope").isNotNull())
    return known.groupBy(*by).agg(
        F.avg(e).alias("Bias"), F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg((F.signum("slope") != F.signum("true_slope")).cast("double")).alias("DirectionError"))

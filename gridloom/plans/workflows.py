"""Composite analyses: prewhitening, a trend test, slopes and false-discovery-rate control in one plan."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice, extra_arguments, probability
from gridloom.operators import fdr, report
from gridloom.operators.direction import direction_map, robust_range, smoothed_masked_slope
from gridloom.operators.grid import GridSpec, Stack
from gridloom.operators.permutation import moran_advice
from gridloom.operators.prewhiten import METHODS as PREWHITEN
from gridloom.operators.prewhiten import prewhiten
from gridloom.operators.slope import METHODS as SLOPES
from gridloom.operators.slope import slope_estimator
from gridloom.operators.trend import METHODS as TESTS
from gridloom.operators.trend import SCHEMAS, trend_test

RESERVED = ("stack", "method")


@dataclass(frozen=True)
class Result:
    """Cells with the trend, slope and rejections; the diagnostics of prewhitening; and how they were made."""

    kind: str
    cells: DataFrame
    spec: GridSpec
    series: Stack
    diagnostics: DataFrame | None
    advice: DataFrame | None
    settings: Mapping[str, object] = field(default_factory=dict)

    @property
    def methods(self) -> tuple[str, ...]:
        method = self.settings.get("fdr_method")
        return (method,) if method else ()

    def summary(self) -> dict[str, DataFrame]:
        """The report tables that apply."""
        out = {"trend": report.trend_summary(self.cells, (self.settings["alpha"],))}
        if "slope" in self.cells.columns:
            out["slope"] = report.slope_summary(self.cells)
            out["numbers"] = report.five_numbers(self.cells, ("slope", "p"))
        if self.methods:
            out["fdr"] = report.fdr_summary(self.cells, self.methods)
            out["direction"] = report.fdr_direction_summary(self.cells, self.methods)
        if self.diagnostics is not None and "Modified" in self.diagnostics.columns:
            out["prewhitening"] = report.prewhiten_summary(self.diagnostics)
        return out

    def plot_data(self, view: str = "direction") -> DataFrame:
        """Plot-ready rows of one view."""
        statistic = SCHEMAS[self.settings["trend_method"]][0]
        if view in ("statistic", "p", "slope", "direction", "significance"):
            column = {"statistic": statistic, "direction": f"direction_{self.methods[0]}" if self.methods else statistic, "significance": f"reject_{self.methods[0]}" if self.methods else "p"}.get(view, view)
            return report.map_panel(self.cells, (column,))
        if view == "p_histogram":
            return report.trend_histograms(self.cells)
        if view == "masked_slope":
            return report.map_panel(smoothed_masked_slope(self.cells, self.spec, reject=f"reject_{self.methods[0]}"), ("slope_masked",))
        if view == "slope_range":
            return robust_range(self.cells, "slope")
        if view == "threshold":
            return fdr.thresholds(self.cells, self.settings["q"])
        if view == "diagnostics" and self.diagnostics is not None:
            return report.map_panel(self.diagnostics, [c for c in self.diagnostics.columns if c not in ("grid_id", "cell", "row", "col", "ok")])
        raise ValueError(f"no view {view}")

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v}' for k, v in self.settings.items())})"


def workflow_trends(
    stack: Stack, prewhiten_method: str = "TFPW_WS", trend_method: str = "CMK", slope_method: str | None = "TS", fdr_method: str | None = "BKY",
    prewhiten_args: Mapping | None = None, trend_args: Mapping | None = None, slope_args: Mapping | None = None, alpha: float = 0.05, q: float = 0.05,
    bky_implementation: str = "multtest", moran_check: bool = False, kind: str = "trends",
) -> Result:
    """Any combination of the steps. Later steps see the prewhitened series on layers 1 to their number.

    The prewhitened series and the tested cells feed several steps and reports, so both are computed here
    and checkpointed; plans stay short and nothing upstream runs twice.
    """
    choice(prewhiten_method, (*PREWHITEN, "none"), "prewhiten_method")
    choice(trend_method, TESTS, "trend_method")
    if slope_method is not None:
        choice(slope_method, SLOPES, "slope_method")
    if fdr_method is not None:
        choice(fdr_method, fdr.METHODS, "fdr_method")
    alpha, q = probability(alpha, "alpha"), probability(q, "q")
    if prewhiten_method != "none" and trend_method == "MMK":
        warnings.warn("prewhitening and the modified Mann-Kendall test correct for autocorrelation twice", stacklevel=2)
    series, diagnostics = stack, None
    if prewhiten_method != "none":
        series, diagnostics = prewhiten(stack, prewhiten_method, **extra_arguments(prewhiten_args, RESERVED, "prewhiten_args"))
        series = Stack(checkpointed(series.cells), series.spec.with_layers(series.spec.n_time))
    cells = trend_test(series, trend_method, **extra_arguments(trend_args, RESERVED, "trend_args"))
    if slope_method:
        slopes = slope_estimator(series, slope_method, **extra_arguments(slope_args, RESERVED, "slope_args"))
        cells = cells.join(slopes.drop("row", "col", "ok"), ["grid_id", "cell"])
    cells = checkpointed(cells)
    advice = moran_advice(cells, stack.spec) if moran_check else None
    if fdr_method:
        cells = fdr.apply(cells.withColumn("reject_raw", F.col("p") <= q), fdr_method, q, bky_implementation)
        cells = cells.withColumnRenamed("q_value", f"q_{fdr_method}").withColumnRenamed("reject", f"reject_{fdr_method}")
        cells = direction_map(cells, (fdr_method,))
    settings = {"prewhiten_method": prewhiten_method, "trend_method": trend_method, "slope_method": slope_method, "fdr_method": fdr_method, "alpha": alpha, "q": q}
    return Result(kind, cells, stack.spec, series, diagnostics, advice, settings)


def workflow_tst(stack: Stack, prewhiten: bool = True, theil_sen: bool = True, fdr_method: str = "BKY", cmk_args: Mapping | None = None, **options) -> Result:
    """True significant trends: selective prewhitening, contextual Mann-Kendall, Theil-Sen, adaptive control."""
    return workflow_trends(stack, "TFPW_WS" if prewhiten else "none", "CMK", "TS" if theil_sen else None, fdr_method, trend_args=cmk_args, kind="tst", **options)


def workflow_rta(stack: Stack, cmk_args: Mapping | None = None, **options) -> Result:
    """Robust trend analysis: Theil-Sen and contextual Mann-Kendall with the BH procedure, without prewhitening."""
    return workflow_trends(stack, "none", "CMK", "TS", "BH", trend_args=cmk_args, kind="rta", **options)

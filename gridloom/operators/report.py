"""Report tables: one aggregate each. Every function takes ``by``, the columns that tell grids apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.validate import probabilities, reference_alpha
from gridloom.operators.direction import direction, sign_source

BY = ("grid_id",)


def _count(c: Column) -> Column:
    return F.count_if(c)


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), digits)


def trend_summary(trend: DataFrame, alpha=(0.05,), by=BY) -> DataFrame:
    """Per level: cells significant and not, percent; and, at every level, increases and decreases among the significant."""
    alphas = probabilities(list(alpha), "alpha")
    source = F.col(sign_source([c for c in trend.columns if c != "slope"]))
    rows = trend.where(F.col("p").isNotNull()).select(*by, "p", source.alias("s"), F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    hit = F.col("p") <= F.col("alpha")
    out = rows.groupBy(*by, "alpha").agg(
        _count(hit).alias("n_significant"), _count(~hit).alias("n_not_significant"), F.count("*").alias("n_valid"),
        _count(hit & (F.col("s") > 0)).alias("n_increase"), _count(hit & (F.col("s") < 0)).alias("n_decrease"))
    return out.withColumn("pct", _percent(F.col("n_significant"), F.col("n_valid"), 2)).withColumn("reference", F.col("alpha") == reference_alpha(alphas))


def fdr_summary(rows: DataFrame, methods=("BH", "BKY"), by=BY) -> DataFrame:
    """One row per procedure (raw first): rejected, not rejected, percent of the valid values."""
    cases = F.array(*(F.struct(F.lit(m).alias("procedure"), F.col(f"reject_{m}").alias("r")) for m in ("raw", *methods)))
    out = rows.select(*by, F.explode(cases).alias("c")).select(*by, "c.procedure", "c.r").where("r is not null")
    out = out.groupBy(*by, "procedure").agg(_count(F.col("r")).alias("n_rejected"), _count(~F.col("r")).alias("n_not_rejected"), F.count("*").alias("n_valid"))
    return out.withColumn("pct", _percent(F.col("n_rejected"), F.col("n_valid"), 3))


def fdr_direction_summary(rows: DataFrame, methods=("BH", "BKY"), source: str | None = None, by=BY) -> DataFrame:
    """Per procedure: cells that increase, decrease or are not significant, and their percents."""
    source = source or sign_source(rows.columns)
    cases = F.array(*(F.struct(F.lit(m).alias("procedure"), direction(F.col(f"reject_{m}"), F.col(source)).alias("d")) for m in methods))
    out = rows.select(*by, F.explode(cases).alias("c")).select(*by, "c.procedure", "c.d").where("d is not null")
    out = out.groupBy(*by, "procedure").agg(
        _count(F.col("d") == 1).alias("n_increase"), _count(F.col("d") == -1).alias("n_decrease"), _count(F.col("d") == 0).alias("n_ns"), F.count("*").alias("n_valid"))
    for k in ("increase", "decrease", "ns"):
        out = out.withColumn(f"pct_{k}", _percent(F.col(f"n_{k}"), F.col("n_valid"), 3))
    return out


def slope_summary(rows: DataFrame, slope: str = "slope", by=BY) -> DataFrame:
    x = F.col(slope)
    out = rows.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.round(F.min(x), 6).alias("min"), F.round(F.median(x), 6).alias("median"), F.round(F.avg(x), 6).alias("mean"), F.round(F.max(x), 6).alias("max"),
        _count(x > 0).alias("n_increasing"), _count(x < 0).alias("n_decreasing"), _count(x == 0).alias("n_flat"))
    for k in ("increasing", "decreasing", "flat"):
        out = out.withColumn(f"pct_{k}", _percent(F.col(f"n_{k}"), F.col("n_valid"), 2))
    return out


def prewhiten_summary(rows: DataFrame, by=BY) -> DataFrame:
    """Valid series, how many were prewhitened, their mean correlation, and the median Durbin-Watson statistic where there is one."""
    changed = F.col("Modified") == 1
    aggregates = [F.count("*").alias("n_valid"), _count(changed).alias("n_prewhitened"), F.avg(F.when(changed, F.col("Rho"))).alias("mean_rho")]
    if "DW_initial" in rows.columns:
        aggregates.append(F.median("DW_initial").alias("median_dw"))
    out = rows.where("Modified is not null").groupBy(*by).agg(*aggregates)
    return out.withColumn("pct", _percent(F.col("n_prewhitened"), F.col("n_valid"), 2))


def five_numbers(rows: DataFrame, columns, by=BY) -> DataFrame:
    """Per named column: n, min, q1, median, mean, q3, max."""
    cases = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))
    out = rows.select(*by, F.explode(cases).alias("c")).select(*by, "c.name", "c.x").where("x is not null")
    return out.groupBy(*by, "name").agg(
        F.count("*").alias("n"), F.min("x").alias("min"), F.percentile("x", F.lit(0.25)).alias("q1"), F.median("x").alias("median"), F.avg("x").alias("mean"),
        F.percentile("x", F.lit(0.75)).alias("q3"), F.max("x").alias("max"))


def tfpw_y_summary(rows: DataFrame, by=BY) -> DataFrame:
    return five_numbers(rows, ("Beta_TheilSen", "Rho"), by)


def direction_counts(rows: DataFrame, column: str, by=BY) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("direction")).agg(F.count("*").alias("n"))


def simulation_summary(truth: DataFrame, by=BY) -> DataFrame:
    """Domain size, true signals and nulls, share of nulls, and the range of the true slopes."""
    out = truth.groupBy(*by).agg(
        F.count("*").alias("DomainCells"), F.sum("true_signal").cast("long").alias("TrueSignals"), F.min("true_slope").alias("SlopeMin"), F.max("true_slope").alias("SlopeMax"))
    out = out.withColumn("TrueNulls", F.col("DomainCells") - F.col("TrueSignals")).withColumn("Pi0", F.col("TrueNulls") / F.col("DomainCells"))
    return out.withColumn("Pct", F.round(100 * F.col("TrueSignals") / F.col("DomainCells"), 2))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by=BY) -> DataFrame:
    """by, bin (1 to bins), lower, upper, n; values on the upper end count in the last bin."""
    x = F.col(value)
    at = F.least(F.lit(bins), F.floor((x - low) / F.lit((high - low) / bins)) + 1).cast("int")
    out = rows.where(x.between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    width = (high - low) / bins
    return out.select(*by, "bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"), (F.lit(low) + F.col("bin") * width).alias("upper"), "n")


def trend_histograms(trend: DataFrame, bins: int = 40, by=BY) -> DataFrame:
    """Histogram of p over [0, 1]."""
    return histogram(trend, "p", 0.0, 1.0, bins, by)


def range_histogram(rows: DataFrame, value: str, bins: int = 40, by=BY, where: Column | None = None) -> DataFrame:
    """by, panel (the value's name), bin (1 to bins), lower, upper, n over the range of the present values that ``where`` admits."""
    x = F.col(value).cast("double")
    some = rows.where(x.isNotNull() & ~F.isnan(x) & (F.lit(True) if where is None else where)).select(*by, x.alias("x"))
    span = some.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"))  # one row a grid
    placed = some.join(span, list(by)).withColumn("width", (F.col("high") - F.col("low")) / bins)
    at = F.when(F.col("width") > 0, F.least(F.lit(bins), F.floor((F.col("x") - F.col("low")) / F.col("width")) + 1)).otherwise(F.lit(1)).cast("int")
    counts = placed.groupBy(*by, at.alias("bin"), "low", "width").agg(F.count("*").alias("n"))
    return counts.select(*by, F.lit(value).alias("panel"), "bin", (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("lower"), (F.col("low") + F.col("bin") * F.col("width")).alias("upper"), "n")


def statistic_histogram(trend: DataFrame, bins: int = 40, by=BY) -> DataFrame:
    """Of the trend statistic: Sm, S or beta, whichever the test gave."""
    return range_histogram(trend, next(c for c in ("Sm", "S", "beta") if c in trend.columns), bins, by)


def slope_histogram(slopes: DataFrame, bins: int = 40, by=BY) -> DataFrame:
    return range_histogram(slopes, "slope", bins, by)


def prewhiten_histograms(diagnostics: DataFrame, bins: int = 40, by=BY) -> DataFrame:
    """Of the initial Durbin-Watson statistic (where there is one), of rho (of prewhitened cells only, where some are told apart), and of
    the preserved or corrected slope."""
    changed = F.col("Modified") == 1 if "Modified" in diagnostics.columns else None
    panels = [("DW_initial", None), ("Rho", changed), ("Beta_TheilSen", None), ("Beta_corrected", changed)]
    out = None
    for name, where in panels:
        if name in diagnostics.columns:
            one = range_histogram(diagnostics, name, bins, by, where)
            out = one if out is None else out.unionByName(one)
    return out


def fdr_histogram(rows: DataFrame, by=BY) -> DataFrame:
    return histogram(rows, "p", 0.0, 1.0, 20, by)


def map_panel(rows: DataFrame, columns, by=BY) -> DataFrame:
    """Plot-ready cells: by, row, col, panel, value for each named column."""
    cases = F.array(*(F.struct(F.lit(c).alias("panel"), F.col(c).cast("double").alias("value")) for c in columns))
    return rows.select(*by, "row", "col", F.explode(cases).alias("c")).select(*by, "row", "col", "c.panel", "c.value")

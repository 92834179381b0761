"""Masks and signs that combine a trend, its rejection and a slope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import GridSpec
from gridloom.operators.spatial import focal_median

SIGN_SOURCES = ("slope", "Sm", "S", "beta")


def significant(p: Column, alpha: float) -> Column:
    """p <= alpha; missing stays missing."""
    return p <= alpha


def masked_slope(slope: Column, reject: Column) -> Column:
    """The slope where the null is rejected; missing where it is not, or where the rejection is missing."""
    return F.when(reject, slope)


def sign_class(x: Column) -> Column:
    return F.signum(x).cast("int")


def direction(reject: Column, source: Column) -> Column:
    """1 rejected and positive, -1 rejected and negative, else 0; missing where either is."""
    return F.when(reject.isNull() | source.isNull(), None).when(reject & (source > 0), 1).when(reject & (source < 0), -1).otherwise(0)


def sign_source(columns: list[str]) -> str:
    for name in SIGN_SOURCES:
        if name in columns:
            return name
    raise ValueError("no slope, Sm, S or beta to take the sign from")


def direction_map(rows: DataFrame, methods: tuple[str, ...] = ("BKY",), source: str | None = None) -> DataFrame:
    """rows with direction_<method> for each reject_<method>."""
    source = source or sign_source(rows.columns)
    for m in methods:
        rows = rows.withColumn(f"direction_{m}", direction(F.col(f"reject_{m}"), F.col(source)))
    return rows


def smoothed_masked_slope(rows: DataFrame, spec: GridSpec, slope: str = "slope", reject: str = "reject_BKY", smooth: bool = True) -> DataFrame:
    """rows with slope_masked, smoothed by a 3 x 3 median of the masked values where asked."""
    out = rows.withColumn("slope_masked", masked_slope(F.col(slope), F.col(reject)))
    return focal_median(out, "slope_masked", spec) if smooth else out


def robust_range(rows: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Per grid, a symmetric range for maps: the smaller of the largest magnitude and k deviations; (-1, 1) for fields of zeros."""
    x = F.col(value)
    r = rows.groupBy("grid_id").agg(F.max(F.abs(x)).alias("top"), F.stddev_samp(x).alias("sd"))
    reach = F.when(F.col("top").isNull() | (F.col("top") == 0), F.lit(1.0)).when(F.col("sd").isNull() | (F.col("sd") == 0), F.col("top")).otherwise(F.least(F.col("top"), k * F.col("sd")))
    return r.select("grid_id", (-reach).alias("lower"), reach.alias("upper"))

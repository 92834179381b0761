"""Climatology and anomalies: window aggregates over (cell, position in the cycle); missing values are tolerated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.validate import choice, positive_integer

CYCLES = {"monthly": 12, "16-day": 23, "semimonthly": 24, "10-day": 36, "8-day": 46, "weekly": 52}


def anomalies(long: DataFrame, n_time: int, cycle: int = 12, cycle_type: str | None = None, start_position: int = 1, standardise: bool = False) -> DataFrame:
    """long (grid_id, cell, t, value) with position, climatology and anomaly.

    The anomaly is the value less the mean of its cell and position; standardised, it is divided by their
    sample deviation, and null where that is 0 or undefined.
    """
    if cycle_type is not None:
        cycle = CYCLES[choice(cycle_type, CYCLES, "cycle_type")]
    cycle, start_position = positive_integer(cycle, "cycle"), positive_integer(start_position, "start_position")
    if cycle < 2 or n_time < cycle or start_position > cycle:
        raise ValueError("a cycle has two positions or more, starts at one of them, and must fit the layers")
    rows = long.withColumn("position", ((F.col("t") - 1 + start_position - 1) % cycle + 1).cast("int"))
    by = Window.partitionBy("grid_id", "cell", "position")
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    rows = rows.withColumn("value", value).withColumn("climatology", F.avg("value").over(by)).withColumn("anomaly", F.col("value") - F.col("climatology"))
    if standardise:
        sd = F.stddev_samp("value").over(by)
        rows = rows.withColumn("__sd", sd).withColumn("anomaly", F.when(F.col("__sd") > 0, F.col("anomaly") / F.col("__sd"))).drop("__sd")
    return rows

"""Grids of series made from the business tables, in Spark and as SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import GridSpec, Stack, to_stack

UNITS = {
    "quarter": "(year(l_shipdate) * 4 + quarter(l_shipdate))",
    "year": "(year(l_shipdate))",
    "month": "(year(l_shipdate) * 12 + month(l_shipdate))",
}


def lineitem_long(spark: SparkSession, sf_dir: str, cells: int, unit: str = "quarter", step: int = 0) -> tuple[DataFrame, int]:
    """(grid_id, cell, t, value) and the number of layers: mean price of a part group per period, to the cent.

    ``step`` > 0 rounds values to multiples, which makes ties.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.expr(UNITS[unit])
    low, high = items.agg(F.min(key), F.max(key)).first()
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    value = cents.cast("double") / F.count("*") / 100
    if step:
        value = F.floor(value / step) * float(step)
    rows = items.groupBy((F.col("l_partkey") % cells + 1).alias("cell"), (key - low + 1).cast("int").alias("t")).agg(value.cast("double").alias("value"))
    return rows.select(F.lit("g").alias("grid_id"), "cell", "t", "value"), high - low + 1


def lineitem_stack(spark: SparkSession, sf_dir: str, cells: int = 100, unit: str = "quarter", step: int = 0) -> Stack:
    long, n = lineitem_long(spark, sf_dir, cells, unit, step)
    side = round(cells**0.5)
    return to_stack(long, GridSpec(cells // side, side, n))


def long_sql(cells: int = 100, unit: str = "quarter", step: int = 0) -> str:
    """Common table expressions: dims (n), long (cell, t, value), cells (cell, row, col, ok), series (complete cells only)."""
    key = UNITS[unit]
    value = "sum(cast(round(l_extendedprice * 100) as bigint))::double / count(*) / 100"
    if step:
        value = f"floor(({value}) / {step}) * {float(step)}"
    side = round(cells**0.5)
    return f"""
dims as (select min({key}) as lo, max({key}) - min({key}) + 1 as n from lineitem),
long as (select l_partkey % {cells} + 1 as cell, {key} - lo + 1 as t, ({value})::double as value from lineitem, dims group by 1, 2),
have as (select cell, count(*) as k from long group by cell),
cells as (
  select i::bigint as cell, ((i - 1) // {side} + 1)::int as row, ((i - 1) % {side} + 1)::int as col, coalesce(k = n, false) as ok
  from range(1, {cells + 1}) u(i) cross join dims left join have on have.cell = i),
series as (select long.cell, t::double as t, value from long join cells on cells.cell = long.cell where ok),
"""

"""Registered queries that read layers and cubes from files, written from the business tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.lineage import shared_dir
from gridloom.operators import trend
from gridloom.operators.grid import GridSpec, to_stack
from gridloom.plans.queries import MK, q6, query, r6, rounded
from gridloom.plans.sample import lineitem_long, long_sql
from gridloom.sources import netcdf, tiff
from gridloom.sources.readers import Layers, read_netcdf_stack, read_ordered_stack


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _placed(long: DataFrame, side: int) -> DataFrame:
    return long.select("t", (F.floor((F.col("cell") - 1) / side) + 1).cast("int").alias("row"), ((F.col("cell") - 1) % side + 1).cast("int").alias("col"), "value")


def price_layers(spark: SparkSession, sf: str, cells: int, **options: str) -> tuple[str, int]:
    """A folder of TIFF layers, one a quarter, named so that the order of names is not the order of time."""
    long, n = lineitem_long(spark, sf, cells)
    path, side = _folder(spark, "layers"), round(cells**0.5)
    tiff.write_layers(_placed(long, side), path, side, side, name="price_year{t}.tif", **options)
    return path, n


def _listed(read: Layers) -> DataFrame:
    return read.values.join(F.broadcast(read.layers.select("t", "layer_name", "time")), "t").select("t", "layer_name", "time", "row", "col", "cell", "value")


LAYERS_SQL = f"""with {long_sql(400)}
every as (select k::int as t, cell, row, col from cells, dims, unnest(range(1, n + 1)) u(k)),
layers as (select e.*, value from every e left join long l on l.cell = e.cell and l.t = e.t)"""


@query(f"""{LAYERS_SQL}
select t, 'price_year' || t as layer_name, t || '.0' as time, row, col, cell, {q6('value')} as value from layers""")
def raster_layers(spark, sf):
    """Every cell of every layer, read back in the order of the numbers in the names; cells without a price are missing."""
    path, _ = price_layers(spark, sf, 400, strip="6")
    return rounded(_listed(read_ordered_stack(spark, directory=path)))


@query(f"""{LAYERS_SQL}
select t, row, col, {q6('value')} as value from layers where t between 9 and 14 and row between 5 and 11 and col between 3 and 4""")
def raster_window(spark, sf):
    """A window of rows, columns and layers: only the strips of these are opened."""
    path, _ = price_layers(spark, sf, 400, strip="2", compression="none")
    return rounded(read_ordered_stack(spark, directory=path, layers=(9, 14), rows=(5, 11), cols=(3, 4)).values.select("t", "row", "col", "value"))


@query(f"""with {long_sql(100)}{MK}
dates as (select min(date_trunc('quarter', l_shipdate)) as first from lineitem)
select cell, {q6('S')} as "S", {q6('VarS')} as "VarS", {q6('p')} as p_value, (select n from dims)::int as n_layers, (select first::date::varchar from dates) as first_time from mk""")
def raster_mann_kendall(spark, sf):
    """From files to a test: layers listed by hand with their dates, stacked, tested."""
    path, n = price_layers(spark, sf, 100, predictor="2")
    first = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.min(F.trunc("l_shipdate", "quarter"))).first()[0]
    dates = [first.replace(year=first.year + (first.month + 3 * k - 1) // 12, month=(first.month + 3 * k - 1) % 12 + 1) for k in range(n)]
    read = read_ordered_stack(spark, files=[f"{path}/price_year{t}.tif" for t in range(1, n + 1)], time=dates)
    made = trend.trend_test(to_stack(read.values, GridSpec(10, 10, n)), "MK").where("S is not null")
    start = read.layers.where("t = 1").select("time")
    return rounded(made.select("cell", "S", "VarS", F.col("p").alias("p_value"))).select("*", F.lit(n).alias("n_layers")).crossJoin(F.broadcast(start.withColumnRenamed("time", "first_time")))


EVENTS_SQL = """days as (select min(date_trunc('day', ts)) as lo, datediff('day', min(ts)::date, max(ts)::date) + 1 as n from events),
totals as (select datediff('day', lo::date, ts::date) + 1 as t, user_id % 400 as cell, count(*)::double as value from events, days group by 1, 2)"""


def event_cube(spark: SparkSession, sf: str, per_file: int | None = None) -> list[str]:
    """Files of a cube of events a day in 20 x 20 cells of users; cells without events are missing."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").alias("day"), (F.col("user_id") % 400).cast("int").alias("cell"))
    low, high = events.agg(F.min("day"), F.max("day")).first()
    n = (high - low).days + 1
    counts = events.groupBy((F.datediff("day", F.lit(low)) + 1).alias("t"), "cell").agg(F.count("*").cast("double").alias("value"))
    path = _folder(spark, "cube")
    placed = counts.select("t", (F.floor(F.col("cell") / 20) + 1).alias("row"), (F.col("cell") % 20 + 1).alias("col"), "value")
    netcdf.write_cube(placed, path, 20, 20, range(n), "events", f"days since {low.isoformat()}", per_file=per_file)
    per_file = per_file or n
    return [f"{path}/cube-{k:06d}.nc" for k in range(-(-n // per_file))]


@query(f"""with {EVENTS_SQL},
every as (select k::int as t, c::int as cell, lo from days, unnest(range(1, n + 1)) u(k), range(0, 400) v(c))
select e.t, strftime(lo + to_days(e.t - 1), '%Y-%m-%d 00:00:00') as time, (e.cell // 20 + 1)::int as row, (e.cell % 20 + 1)::int as col, {q6('value')} as value
from every e left join totals x on x.t = e.t and x.cell = e.cell""")
def netcdf_cube(spark, sf):
    """A cube in several files, read as one by its times."""
    read = read_netcdf_stack(spark, event_cube(spark, sf, 7)[::-1], "events")
    return rounded(_listed(read).select("t", "time", "row", "col", "value"))


@query(f"""with {EVENTS_SQL}
select t::int as t, {q6('sum(value)')} as total, count(*)::bigint as cells from totals where t between 4 and 20 and cell // 20 between 2 and 9 group by t""")
def netcdf_window(spark, sf):
    """Totals of some days and rows of a cube in one file: other records and rows are not read."""
    values, *_ = netcdf.read_cube(spark, event_cube(spark, sf), layers=(4, 20), rows=(3, 10))
    return values.where("value is not null").groupBy("t").agg(r6(F.sum("value")).alias("total"), F.count("*").alias("cells"))

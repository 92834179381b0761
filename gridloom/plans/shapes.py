"""Registered queries over polygons, histograms and decisions made from the tables' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import inspect, prewhiten, report, scoring, slope, topology, trend
from gridloom.operators.grid import GridSpec, to_stack
from gridloom.plans.queries import FIELD, LAGGED, MK, SEN, TIES, VARIANCE, ZP, _field, _gate, iterative_sql, neighbours_sql, q6, query, rounded
from gridloom.plans.sample import lineitem_long, lineitem_stack, long_sql

# ------------------------------------------------------------------ polygons

CORNERS = "corners as (select n_regionkey as polygon, n_nationkey as k, (n_nationkey * 7 + n_regionkey * 3) % 23 - 1.3::double as x, (n_nationkey * 11 + n_regionkey * 5) % 22 - 0.7::double as y from nation),"
EDGES = """ring as (select polygon, x as x1, y as y1, coalesce(lead(x) over o, first_value(x) over o) as x2, coalesce(lead(y) over o, first_value(y) over o) as y2 from corners window o as (partition by polygon order by k)),
inside as (
  select polygon, cell from ring, cells
  where (y1 <= row - 0.5::double and row - 0.5::double < y2) or (y2 <= row - 0.5::double and row - 0.5::double < y1)
  group by polygon, cell, row, col having count(*) filter (x1 + (row - 0.5::double - y1) * (x2 - x1) / (y2 - y1) > col - 0.5::double) % 2 = 1)"""


def nation_rings(spark: SparkSession, sf: str) -> DataFrame:
    """A polygon a region, with a corner a nation; edges may cross."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(r.alias("polygon"), F.struct(k.alias("k"), ((k * 7 + r * 3) % 23 - 1.3).alias("x"), ((k * 11 + r * 5) % 22 - 0.7).alias("y")).alias("corner"))
    return rows.groupBy("polygon").agg(F.sort_array(F.collect_list("corner")).alias("ring"))


@query(f"""with {long_sql(400)}{CORNERS}{EDGES}
select i.polygon, l.t::int as t, {q6('quantile_cont(value, 0.5)')} as value from inside i join long l using (cell) group by 1, 2""")
def polygon_series(spark, sf):
    """Median prices of the cells in each polygon."""
    made = inspect.polygon_series(lineitem_stack(spark, sf, 400), nation_rings(spark, sf)).where("value is not null")
    return rounded(made.select("polygon", "t", "value"))


# ------------------------------------------------------------------ histograms


def _bins_sql(panels: list[tuple[str, str, str]]) -> str:
    """(panel, bin, lower, upper, n) of 40 bins: panels as (name, expression, source)."""
    each = " union all ".join(f"select '{name}' as panel, ({x})::double as x from {source}" for name, x, source in panels)
    return f"""v as (select * from ({each}) where x is not null),
sp as (select panel, min(x) as low, (max(x) - min(x)) / 40 as width from v group by panel),
b as (select panel, low, width, case when width > 0 then least(40, floor((x - low) / width) + 1) else 1 end::int as bin from v join sp using (panel))
select panel, bin, {q6('low + (bin - 1) * width')} as lower, {q6('low + bin * width')} as upper, count(*) as n from b group by panel, bin, low, width"""


@query(f"with {long_sql(100)}{MK}{SEN}" + _bins_sql([("S", "S", "mk"), ("slope", "slope", "sen")]))
def trend_value_histograms(spark, sf):
    stack = lineitem_stack(spark, sf)
    made = report.statistic_histogram(trend.trend_test(stack, "MK")).unionByName(report.slope_histogram(slope.slope_estimator(stack)))
    return rounded(made)


@query(f"with recursive {long_sql(100)}{iterative_sql(_gate('threshold'))}" + _bins_sql([("DW_initial", "dw", "itn"), ("Rho", "rho", "itn where changed")]))
def prewhiten_value_histograms(spark, sf):
    _, diagnostics = prewhiten.prewhiten(lineitem_stack(spark, sf), "TFPW_WS")
    return rounded(report.prewhiten_histograms(diagnostics))


# ------------------------------------------------------------------ decisions against what came later

SHOWN = ("Sensitivity", "Specificity", "Precision", "Accuracy", "FPR", "FDR", "DirectionalPower")
EARLY = 20
ALPHAS = {"strict": 0.05, "loose": 0.2, "open": 0.5}


def _outlook_sql() -> str:
    made = ", ".join(f"('{m}', {a})" for m, a in ALPHAS.items())
    ratio = lambda a, b: f"case when {b} <> 0 then ({a})::double / ({b}) end"
    shown = {
        "Sensitivity": ratio("tp", "tp + fn"), "Specificity": ratio("tn", "tn + fp"), "Precision": ratio("tp", "tp + fp"), "Accuracy": ratio("tp + tn", "tp + fp + tn + fn"), "FPR": ratio("fp", "fp + tn"),
        "FDR": f"case when tp + fp = 0 then 0.0::double else {ratio('fp', 'tp + fp')} end", "DirectionalPower": ratio("good", "tp + fn"),
    }
    return f"""with {long_sql(100)}
whole as (select * from series), early as (select * from whole where t <= {EARLY}),
score as (select a.cell, sum(sign(b.value - a.value))::double as S from early a join early b on a.cell = b.cell and a.t < b.t group by a.cell),
{TIES.replace('from series', 'from early')}{VARIANCE.replace('n * (n - 1) * (2 * n + 5)', f'{EARLY} * {EARLY - 1} * {2 * EARLY + 5}')}
z as (select cell, S, case when S = 0 then 0.0::double else (S - sign(S)) / sqrt(VarS) end as z from score join variance using (cell)),
p as (select cell, S, {ZP} as p from z),
later as (select cell, avg(value) filter (t > {EARLY}) - avg(value) filter (t <= {EARLY}) as step, avg(value) as level from whole group by cell),
truth as (select cell, abs(step) > 0.01 * level as signal, sign(step)::int as td from later),
d as (select m.method, p.cell, p <= alpha as sig, sign(S)::int as dir, signal, td from p, (values {made}) m(method, alpha), truth where truth.cell = p.cell),
c as (
  select method, count(*) filter (sig and signal) as tp, count(*) filter (sig and not signal) as fp, count(*) filter (not sig and not signal) as tn, count(*) filter (not sig and signal) as fn,
    count(*) filter (sig and signal and dir = td) as good from d group by method)
select method, tp::bigint as "TP", fp::bigint as "FP", tn::bigint as "TN", fn::bigint as "FN", {', '.join(f'{q6(x)} as "{k}"' for k, x in shown.items())} from c"""


@query(_outlook_sql())
def outlook_scores(spark, sf):
    """Mann-Kendall decisions on the first layers, at three levels, scored against the change of price that the held-out layers show."""
    long, n = lineitem_long(spark, sf, 100)
    whole = to_stack(long, GridSpec(10, 10, n))
    early = to_stack(long.where(F.col("t") <= EARLY), GridSpec(10, 10, EARLY))
    p = trend.trend_test(early, "MK").join(whole.cells.where("ok").select("grid_id", "cell"), ["grid_id", "cell"], "left_semi")
    methods = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(a).alias("alpha")) for m, a in ALPHAS.items()))
    found = p.withColumn("m", F.explode(methods)).select("m.method", "cell", (F.col("p") <= F.col("m.alpha")).alias("significant"), F.signum("S").cast("int").alias("direction"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    y = F.col("y")
    step = mean(F.slice(y, EARLY + 1, n - EARLY)) - mean(F.slice(y, 1, EARLY))
    truth = whole.cells.where("ok").select("cell", (F.abs(step) > 0.01 * mean(y)).alias("signal"), F.signum(step).cast("int").alias("direction"))
    return rounded(scoring.compare_detections(found, truth, SHOWN))


# ------------------------------------------------------------------ one topology for several tests


@query(f"""with {long_sql(400)}{FIELD}{neighbours_sql()}{LAGGED}
m as (select count(*) / sum(k)::double * sum(z * wz) / sum(z * z) as i, count(*) as n, sum(k)::bigint as s0, sum(z * z) / count(*) as m2 from wz)
select cell, k::bigint as k, {q6('case when k > 0 then z * wz / m2 end')} as local_i, {q6('i')} as global_i, n, s0 from wz, m""")
def topology_reuse(spark, sf):
    """Neighbour counts, local and global Moran of a field over one stored topology."""
    field, stack = _field(spark, sf, 400)
    made = topology.prepare(field, stack.spec, valid="x is not null")
    whole = topology.global_statistic(made, field, stack.spec).select("grid_id", F.col("statistic").alias("global_i"), "n", "s0")
    local = topology.local_statistic(made, field, stack.spec).withColumnRenamed("statistic", "local_i")
    return rounded(topology.with_neighbours(made, local).join(F.broadcast(whole), "grid_id").select("cell", "k", "local_i", "global_i", "n", "s0"))

"""Registered queries of the grid operators with their SQL. Results are rounded on both sides to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import series as S
from gridloom.functions.dist import Z_975, normal_quantile, normal_two_sided_sql, t_quantile, t_two_sided_sql
from gridloom.functions.feistel import permute_sql
from gridloom.operators import anomalies as anomaly
from gridloom.operators import benchmark, fdr, inspect, permutation, prewhiten, report, scoring, simulate, slope, spatial, trend
from gridloom.operators.direction import direction, direction_map, robust_range, smoothed_masked_slope
from gridloom.operators.grid import Stack, when_ok
from gridloom.plans.sample import UNITS, lineitem_long, lineitem_stack, long_sql
from gridloom.plans.workflows import workflow_rta, workflow_trends, workflow_tst
from gridloom.sources import calendar
from gridloom.sources.readers import long_from_cubes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, other columns as they are, without the grid id."""
    return df.select(*(r6(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c != "grid_id" or "grid_id" in keep))


def q6(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::double)"


# ------------------------------------------------------------------ shared SQL

SCORE = "score as (select a.cell, sum(sign(b.value - a.value))::double as S from series a join series b on a.cell = b.cell and a.t < b.t group by a.cell),"
TIES = "tie as (select cell, sum(g * (g - 1) * (2 * g + 5))::double as w from (select cell, count(*) as g from series group by cell, value) group by cell),"
VARIANCE = "variance as (select cell, (n * (n - 1) * (2 * n + 5) - w)::double / 18 as VarS from tie, dims),"
ZP = normal_two_sided_sql("z")
MK = f"""{SCORE}{TIES}{VARIANCE}
zs as (select s.cell, S, VarS, case when S = 0 then 0.0::double else (S - sign(S)) / sqrt(VarS) end as z from score s join variance using (cell)),
mk as (select cell, S, VarS, {ZP} as p from zs),"""
SLOPES = "slopes as (select a.cell, (b.value - a.value) / (b.t - a.t) as s from series a join series b on a.cell = b.cell and a.t < b.t),"
SEN = SLOPES + "sen as (select cell, quantile_cont(s, 0.5) as slope from slopes group by cell),"
FIT = """
mom as (select cell, avg(t) as tb, avg(value) as yb from series group by cell),
ols as (select s.cell, any_value(tb) as tb, any_value(yb) as yb, sum((t - tb) * (value - yb)) / sum((t - tb) * (t - tb)) as slope, sum((t - tb) * (t - tb)) as sxx from series s join mom using (cell) group by s.cell),
res as (select s.cell, t, value - (yb - slope * tb) - slope * t as e from series s join ols using (cell)),
rss as (select cell, sum(e * e) as rss from res group by cell),"""


def neighbours_sql(side: int = 10, reach: int = 1, rook: bool = False, include_self: bool = False) -> str:
    cross = " and (a.row = b.row or a.col = b.col)" if rook else ""
    self = "" if include_self else " and a.cell <> b.cell"
    return f"nbr as (select a.cell, b.cell as nbr from cells a join cells b on b.row between a.row - {reach} and a.row + {reach} and b.col between a.col - {reach} and a.col + {reach}{cross}{self}),"


def cmk_sql(reach: int = 1, rook: bool = False, continuity: bool = False) -> str:
    top = "(case when Sm > 0 then Sm - 1 else Sm + 1 end)" if continuity else "Sm"
    return MK + neighbours_sql(reach=reach, rook=rook, include_self=True) + f"""
sd as (select cell, avg(value) as m, stddev_samp(value) as sd from series group by cell),
v as (select s.cell, s.t, case when sd > 0 then (value - m) / (sqrt(n::double) * sd) * sqrt(VarS) else 0.0::double end as v from series s join sd using (cell) join variance using (cell), dims),
vn as (select cell, sum(v * v) as vv from v group by cell),
reg as (select nbr.cell, count(*) as m, sum(mk.S) as S, sum(mk.VarS - vv) as own from nbr join mk on mk.cell = nbr.nbr join vn on vn.cell = nbr.nbr group by nbr.cell),
vt as (select nbr.cell, v.t, sum(v) as v from nbr join v on v.cell = nbr.nbr group by nbr.cell, v.t),
sq as (select cell, sum(v * v) as q from vt group by cell),
cm as (select reg.cell, S / m as Sm, (q + own) / (m * m) as VarSm from reg join sq using (cell) join cells using (cell) where ok),
cz as (select *, case when VarSm > 0 then {top} / sqrt(VarSm) else 0.0::double end as z from cm),
cmk as (select cell, Sm, VarSm, {ZP} as p from cz),"""


def fdr_sql(source: str, q: float = 0.05) -> str:
    """ranks of source (id, p): bh, by, bky (multtest), with m, r1, pi0."""
    return f"""
pv as (select id, p from {source} where p is not null),
rk as (select id, p, count(*) over (order by p) as r, count(*) over () as m from pv),
ad as (select id, p, r, m, min(m * p / r) over (order by p desc) as raw from rk),
bh as (select id, p, r, m, least(1.0::double, raw) as bh, least(1.0::double, raw * (select sum(1.0::double / k) from range(1, (select max(m) from rk) + 1) u(k))) as by_ from ad),
st as (select count(*) filter (bh < {q / (1 + q)!r}) as r1, max(m) as m from bh),
bky as (select id, p, bh.r, bh.m, bh, by_, r1, (bh.m - r1) / bh.m::double as pi0, bh * ((bh.m - r1) / bh.m::double) as bky from bh, st),"""


# ------------------------------------------------------------------ temporal kernels

CELLS = "select c.cell, c.row, c.col, c.ok"
AT = "from cells c left join"


@query(f"with {long_sql(100)}{MK} x as (select 1) {CELLS}, S as \"S\", {q6('VarS')} as \"VarS\", {q6('p')} as p {AT} mk using (cell)")
def mann_kendall(spark, sf):
    return rounded(trend.trend_test(lineitem_stack(spark, sf), "MK"))


@query(f"with {long_sql(100, 'quarter', 2000)}{MK} x as (select 1) {CELLS}, S as \"S\", {q6('VarS')} as \"VarS\", {q6('p')} as p {AT} mk using (cell)")
def mann_kendall_ties(spark, sf):
    return rounded(trend.trend_test(lineitem_stack(spark, sf, step=2000), "MK", ties=True))


@query(f"with {long_sql(100, 'quarter', 2000)}{SCORE} v as (select cell, S, (n * (n - 1) * (2 * n + 5))::double / 18 as VarS from score, dims), zs as (select *, case when S = 0 then 0.0::double else (S - sign(S)) / sqrt(VarS) end as z from v), mk as (select cell, S, VarS, {ZP} as p from zs) {CELLS}, S as \"S\", {q6('VarS')} as \"VarS\", {q6('p')} as p {AT} mk using (cell)")
def mann_kendall_no_ties(spark, sf):
    return rounded(trend.trend_test(lineitem_stack(spark, sf, step=2000), "MK", ties=False))


def _ols_sql() -> str:
    df = {"quarter": 26}["quarter"]
    return f"""with {long_sql(100)}{FIT}
f as (select o.cell, slope as beta, sqrt(rss / (n - 2) / sxx) as se_beta from ols o join rss using (cell), dims),
tt as (select *, beta / se_beta as tstat from f)
{CELLS}, {q6('beta')} as beta, {q6('se_beta')} as se_beta, {q6(t_two_sided_sql('tstat', df))} as p {AT} tt using (cell)"""


@query(_ols_sql())
def ols_trend(spark, sf):
    return rounded(trend.trend_test(lineitem_stack(spark, sf), "OLS"))


MMK = MK + SEN + f"""
det as (select s.cell, t, value - slope * t as x from series s join sen using (cell)),
rks as (select cell, t, rank() over (partition by cell order by x) + (count(*) over (partition by cell, x) - 1) / 2.0::double as r from det),
rc as (select cell, t, r - avg(r) over (partition by cell) as r from rks),
ss as (select cell, sum(r * r) as d from rc group by cell),
ac as (select a.cell, (b.t - a.t) as k, sum(a.r * b.r) / any_value(d) as rho from rc a join rc b on a.cell = b.cell and b.t > a.t join ss on ss.cell = a.cell group by a.cell, b.t - a.t),
ef as (select cell, 1 + 2.0::double / (any_value(n) * (any_value(n) - 1) * (any_value(n) - 2)) * sum(case when abs(rho) > {Z_975!r} / sqrt(n::double) then (n - k) * (n - k - 1) * (n - k - 2) * rho else 0 end) as essf from ac, dims group by cell),
mz as (select mk.cell, S, case when essf > 0 then VarS * essf end as VarS, case when essf > 0 then case when S = 0 then 0.0::double else (S - sign(S)) / sqrt(VarS * essf) end end as z from mk join ef using (cell)),
mmk as (select cell, S, VarS, {ZP} as p from mz),"""


@query(f"with {long_sql(100)}{MMK} x as (select 1) {CELLS}, S as \"S\", {q6('VarS', 4)} as \"VarS\", {q6('p', 5)} as p {AT} mmk using (cell)")
def modified_mann_kendall(spark, sf):
    rows = trend.trend_test(lineitem_stack(spark, sf), "MMK")
    return rows.select("cell", "row", "col", "ok", "S", r6("VarS", 4).alias("VarS"), r6("p", 5).alias("p"))


@query(f"""with {long_sql(100)}
c as (select cell, t, value - avg(value) over (partition by cell) as v from series),
d as (select cell, sum(v * v) as d from c group by cell),
a as (select a.cell, (b.t - a.t)::int as lag, sum(a.v * b.v) as x from c a join c b on a.cell = b.cell and b.t > a.t group by 1, 2)
select a.cell, lag, {q6('case when d = 0 then 0.0::double else x / d end')} as acf from a join d using (cell)""")
def autocorrelations(spark, sf):
    stack = lineitem_stack(spark, sf)
    lags = F.transform(F.sequence(F.lit(1), F.lit(stack.spec.n_time - 1)), lambda k: F.struct(k.alias("lag"), S.autocorrelation(F.col("y"), k).alias("acf")))
    return rounded(stack.cells.where("ok").select("cell", F.inline(lags)))


@query(f"""with {long_sql(100)}{FIT}
p as (select cell, e, lag(e) over (partition by cell order by t) as b, row_number() over (partition by cell order by t desc) as k from res),
d as (select cell, sum((e - b) * (e - b)) / sum(e * e) as dw, sum(e * b) / sum(case when k > 1 then e * e end) as rho1 from p group by cell)
{CELLS}, {q6('dw')} as dw, {q6('rho1')} as rho1, 1.328::double as d_lower, 1.476::double as d_upper {AT} d using (cell)""")
def durbin_watson(spark, sf):
    stack = lineitem_stack(spark, sf)
    low, high = prewhiten.dw_critical_values(stack.spec.n_time)
    return rounded(prewhiten.durbin_watson(stack).select("cell", "row", "col", "ok", "dw", "rho1", F.lit(low).alias("d_lower"), F.lit(high).alias("d_upper")))


@query(f"with {long_sql(400)}{SEN} x as (select 1) {CELLS}, {q6('slope')} as slope {AT} sen using (cell)")
def theil_sen_missing(spark, sf):
    return rounded(slope.slope_estimator(lineitem_stack(spark, sf, 400), "TS"))


@query(f"with {long_sql(100)}{SEN} x as (select 1) {CELLS}, {q6('slope')} as slope {AT} sen using (cell)")
def theil_sen(spark, sf):
    return rounded(slope.slope_estimator(lineitem_stack(spark, sf), "TS"))


@query(f"with {long_sql(100)}{SEN} x as (select 1) select cell, {q6('slope')} as slope from sen")
def theil_sen_by_join(spark, sf):
    long, n = lineitem_long(spark, sf, 100)
    complete = long.groupBy("grid_id", "cell").count().where(F.col("count") == n).drop("count")
    return rounded(slope.theil_sen_long(long.join(complete, ["grid_id", "cell"]).withColumn("t_value", F.col("t").cast("double"))))


def _rm_sql() -> str:
    return f"""with {long_sql(100)}
pr as (select a.cell, a.t, (b.value - a.value) / (b.t - a.t) as s, a.value - (b.value - a.value) / (b.t - a.t) * a.t as i from series a join series b on a.cell = b.cell and a.t <> b.t),
inn as (select cell, t, list_sort(list(s))[count(*) // 2 + 1] as s, list_sort(list(i))[count(*) // 2 + 1] as i from pr group by cell, t),
rm as (select cell, list_sort(list(s))[count(*) // 2 + 1] as slope, list_sort(list(i))[count(*) // 2 + 1] as intercept from inn group by cell)
select cell, {q6('slope')} as slope, {q6('intercept')} as intercept from rm"""


@query(_rm_sql())
def repeated_median(spark, sf):
    return rounded(slope.fit_series(lineitem_stack(spark, sf), "RM").select("cell", "slope", "intercept"))


TFPW_Y = SEN + """
dt as (select s.cell, t, value - slope * t as r, slope from series s join sen using (cell)),
cn as (select cell, t, r, slope, r - avg(r) over (partition by cell) as c from dt),
pr as (select cell, t, r, slope, c, lag(c) over w as cb, lag(r) over w as rb from cn window w as (partition by cell order by t)),
rh as (select cell, greatest(-0.99::double, least(0.99::double, sum(c * cb) / sum(c * c))) as rho from pr group by cell),"""


@query(f"with {long_sql(100)}{TFPW_Y} x as (select 1) select pr.cell, (t - 1)::int as t, {q6('r - rho * rb + slope * t')} as value, {q6('slope')} as beta, {q6('rho')} as rho from pr join rh using (cell) where t > 1")
def tfpw_yue_pilon(spark, sf):
    out, d = prewhiten.prewhiten(lineitem_stack(spark, sf), "TFPW_Y")
    rows = out.cells.where("ok").select("grid_id", "cell", F.posexplode("y").alias("k", "value"))
    d = d.select("grid_id", "cell", F.col("Beta_TheilSen").alias("beta"), F.col("Rho").alias("rho"))
    return rounded(rows.select("grid_id", "cell", (F.col("k") + 1).alias("t"), "value").join(d, ["grid_id", "cell"]).select("cell", "t", "value", "beta", "rho"))


VCTFPW = SEN + f"""
dt as (select s.cell, t, value, value - slope * (t - 1) as d, slope from series s join sen using (cell)),
cn as (select *, d - avg(d) over (partition by cell) as c, lag(d) over (partition by cell order by t) as db from dt),
pr as (select *, lag(c) over (partition by cell order by t) as cb from cn),
rh as (select cell, sum(c * cb) / sum(c * c) as rho from pr group by cell),
wh as (select pr.*, rho, coalesce(d - rho * db, d) as r from pr join rh using (cell)),
sc as (select cell, var_samp(value) / var_samp(r) as k, any_value(rho) as rho, any_value(slope) as slope from wh group by cell),
nb as (select cell, k, abs(rho) > {Z_975!r} / sqrt(n::double) as ch, case when rho > 0 then slope / sqrt((1 + rho) / (1 - rho)) else slope end as beta from sc, dims),"""


@query(f"with {long_sql(100)}{VCTFPW} x as (select 1) select wh.cell, t::int as t, {q6('case when ch then r * k + beta * (t - 1) else value end', 5)} as value, {q6('rho')} as rho, ch::int as modified from wh join nb using (cell)")
def tfpw_variance_corrected(spark, sf):
    out, d = prewhiten.prewhiten(lineitem_stack(spark, sf), "VCTFPW")
    rows = out.cells.where("ok").select("grid_id", "cell", F.posexplode("y").alias("k", "value"))
    d = d.select("grid_id", "cell", F.col("Rho").alias("rho"), F.col("Modified").alias("modified"))
    return rows.join(d, ["grid_id", "cell"]).select("cell", (F.col("k") + 1).alias("t"), r6("value", 5).alias("value"), r6("rho").alias("rho"), "modified")


def iterative_sql(gate: str, refit: str = "OLS", source: str = "series") -> str:
    """The iterative prewhitening of source as a recursive query: itn (cell, y, tt, dw, gated, rho, clamped, changed) and white (cell, t, value)."""
    if refit == "TS":
        slope = "list_median(flatten(list_transform(range(1, len(u)), lambda i: list_transform(range(i + 1, len(u) + 1), lambda j: (u[j] - u[i]) / (tt[j] - tt[i])))))"
    else:
        slope = "list_sum(list_transform(range(1, len(u) + 1), lambda i: (u[i] - ub) * (tt[i] - tb))) / list_sum(list_transform(range(1, len(u) + 1), lambda i: (tt[i] - tb) * (tt[i] - tb)))"

    def lag(x: str, rest: str, inner: str) -> str:
        c = f"select {rest}, list_transform({x}, lambda v: v - xb) as c from (select *, list_avg({x}) as xb from ({inner}))"
        return f"select {rest}, case when d > 0 then list_sum(list_transform(range(2, len(c) + 1), lambda i: c[i] * c[i - 1])) / d else 0.0::double end as nr from (select *, list_sum(list_transform(c, lambda v: v * v)) as d from ({c}))"

    white = "select r.cell, r.k, r.clamped, gate.y, gate.tt, list_transform(range(1, len(gate.y)), lambda i: (gate.y[i + 1] - r.rho * gate.y[i]) / (1 - r.rho)) as u from rec r join gate on gate.cell = r.cell where r.k < 20"
    trend = f"select *, {slope} as slope from (select *, list_avg(u) as ub, list_avg(tt[1:len(u)]) as tb from ({white}))"
    left = f"select *, list_transform(range(1, len(y) + 1), lambda i: y[i] - slope * tt[i]) as e from ({trend})"
    mom = f"imom as (select cell, avg(t) as tb, avg(value) as yb from {source} group by cell), iols as (select s.cell, any_value(tb) as tb, any_value(yb) as yb, sum((t - tb) * (value - yb)) / sum((t - tb) * (t - tb)) as slope from {source} s join imom using (cell) group by s.cell),"
    return f"""{mom}
ires as (select s.cell, t, value - (yb - slope * tb) - slope * t as e from {source} s join iols using (cell)),
idw as (select cell, sum((e - b) * (e - b)) / sum(e * e) as dw from (select *, lag(e) over (partition by cell order by t) as b from ires) group by cell),
arr as (select cell, list(value order by t) as y, list(t order by t) as tt from {source} group by cell),
gate as (select arr.cell, y, tt from arr join idw using (cell) where {gate}),
rec(cell, k, rho, clamped) as (
  select cell, 0, nr, false from ({lag('y', 'cell', 'select cell, y from gate')})
  union all
  select cell, k + 1, case when nr >= 1 then 0.99::double when nr <= -1 then -0.99::double else nr end, clamped or nr >= 1 or nr <= -1 from ({lag('e', 'cell, k, clamped', left)})),
move as (select b.k, max(abs(b.rho - a.rho)) as move from rec a join rec b on a.cell = b.cell and b.k = a.k + 1 group by b.k),
halt as (select coalesce(min(case when move < 1e-4 then k end), 20) as stop from move),
itn as (
  select arr.cell, y, tt, dw, rec.cell is not null as gated, rec.rho, coalesce(rec.clamped, false) as clamped, rec.cell is not null and not coalesce(rec.clamped, false) as changed
  from arr join idw using (cell) cross join halt left join rec on rec.cell = arr.cell and rec.k = halt.stop),
white as (
  select cell, tt[i]::double as t, case when not changed then y[i] when i = 1 then y[1] * sqrt(1 - rho * rho) else (y[i] - rho * y[i - 1]) / (1 - rho) end as value
  from itn, unnest(range(1, len(y) + 1)) u(i)),"""


def _gate(kind: str) -> str:
    """The Durbin-Watson gates of 28 layers."""
    return {"threshold": "dw < 1.4 or dw > 2.6", "test": "dw < 1.476 or dw > 4 - 1.476", "none": "true"}[kind]


def _iterative_query(kind: str, refit: str = "OLS", dw: bool = True) -> str:
    first = f", {q6('dw')} as \"DW_initial\"" if dw else ""
    return f"""with recursive {long_sql(100)}{iterative_sql(_gate(kind), refit)} x as (select 1)
select itn.cell, white.t::int as t, {q6('white.value', 5)} as value{first}, {q6('case when gated then rho else 0.0::double end', 5)} as "Rho", changed::int as "Modified", (gated and clamped)::int as "Clamped" from itn join white using (cell)"""


def _prewhitened(stack: Stack, method: str, **options) -> DataFrame:
    out, d = prewhiten.prewhiten(stack, method, **options)
    rows = out.cells.where("ok").select("grid_id", "cell", F.posexplode("y").alias("k", "value"))
    rows = rows.join(d.drop("row", "col", "ok"), ["grid_id", "cell"]).withColumn("t", F.col("k") + 1)
    return rows.select(
        "cell", "t", r6("value", 5).alias("value"), *(r6(c).alias(c) for c in ("DW_initial",) if c in d.columns), r6("Rho", 5).alias("Rho"), "Modified", "Clamped")


@query(_iterative_query("threshold"))
def tfpw_wang_swail(spark, sf):
    return _prewhitened(lineitem_stack(spark, sf), "TFPW_WS")


@query(_iterative_query("test", "TS"))
def tfpw_wang_swail_test_gate(spark, sf):
    return _prewhitened(lineitem_stack(spark, sf), "TFPW_WS", gate="test", refit_method="TS")


@query(_iterative_query("none", dw=False))
def tfpw_zhang(spark, sf):
    return _prewhitened(lineitem_stack(spark, sf), "TFPW_Z")


@query(f"""with recursive {long_sql(100)}{SLOPES}{iterative_sql(_gate('threshold'))}
truth as (select cell, quantile_cont(s, 0.5) as slope from slopes group by cell),
wmom as (select cell, avg(t) as tb, avg(value) as yb from white group by cell),
wols as (select w.cell, any_value(tb) as tb, any_value(yb) as yb, sum((t - tb) * (value - yb)) / sum((t - tb) * (t - tb)) as slope from white w join wmom using (cell) group by w.cell),
wres as (select w.cell, t, value - (yb - slope * tb) - slope * t as e from white w join wols using (cell)),
r as (select cell, case when stddev_samp(e) > 0 and stddev_samp(b) > 0 then corr(e, b) end as r from (select *, lag(e) over (partition by cell order by t) as b from wres) where b is not null group by cell)
select {q6('avg(r)', 5)} as "ResidualACF1", {q6('avg(abs(r))', 5)} as "AbsResidualACF1", {q6('avg(wols.slope - truth.slope)', 5)} as "SlopeBias", {q6('avg(abs(wols.slope - truth.slope))', 5)} as "SlopeMAE",
  {q6('sqrt(avg((wols.slope - truth.slope) * (wols.slope - truth.slope)))', 5)} as "SlopeRMSE", {q6('avg(changed::int)')} as "ModifiedFraction", max(len(y))::double as "OutputLength"
from itn join r using (cell) join wols using (cell) join truth using (cell)""")
def prewhitening_scores(spark, sf):
    stack = lineitem_stack(spark, sf)
    out, d = prewhiten.prewhiten(stack, "TFPW_WS")
    result = out.cells.where("ok").select("grid_id", "cell", "y").join(d.select("grid_id", "cell", "Modified"), ["grid_id", "cell"])
    truth = slope.slope_estimator(stack).select("grid_id", "cell", F.col("slope").alias("true_slope"))
    return rounded(benchmark.prewhitening_scores(result, truth), 5)


def _ci_sql() -> str:
    z = normal_quantile(0.975)
    return f"""with {long_sql(100)}{TIES}{VARIANCE}{SLOPES}
o as (select cell, list_sort(list(s)) as l, count(*)::double as k from slopes group by cell),
b as (select cell, l, greatest(round_even((k - {z!r} * sqrt(VarS)) / 2, 0), 1)::int as lo, least(round_even((k + {z!r} * sqrt(VarS)) / 2, 0) + 1, k)::int as hi from o join variance using (cell))
select cell, {q6('l[lo]')} as lower, {q6('l[hi]')} as upper from b"""


@query(_ci_sql())
def sen_interval(spark, sf):
    return rounded(slope.fit_series(lineitem_stack(spark, sf), "TS").select("cell", "lower", "upper"))


def _ols_ci_sql() -> str:
    t = t_quantile(0.975, 26)
    return f"""with {long_sql(100)}{FIT}
f as (select o.cell, slope, yb - slope * tb as intercept, sqrt(rss / (n - 2) / sxx) as se from ols o join rss using (cell), dims)
select cell, {q6('slope')} as slope, {q6('intercept')} as intercept, {q6(f'slope - {t!r} * se')} as lower, {q6(f'slope + {t!r} * se')} as upper from f"""


@query(_ols_ci_sql())
def ols_interval(spark, sf):
    return rounded(slope.fit_series(lineitem_stack(spark, sf), "OLS"))


@query(f"""with {long_sql(100)}{SEN}
i as (select s.cell, quantile_cont(value - slope * t, 0.5) as intercept from series s join sen using (cell) group by s.cell)
select sen.cell, {q6('slope')} as slope, {q6('intercept')} as intercept from sen join i using (cell)""")
def theil_sen_fit(spark, sf):
    return rounded(slope.fit_series(lineitem_stack(spark, sf), "TS").select("cell", "slope", "intercept"))


def _anomaly_sql(standard: bool) -> str:
    a = "value - clim"
    return f"""with {long_sql(400)}
p as (select cell, t, value, ((t - 1 + 1) % 4 + 1)::int as position from long),
c as (select *, avg(value) over w as clim, stddev_samp(value) over w as sd from p window w as (partition by cell, position))
select cell, t::int as t, {q6('value')} as value, position, {q6('clim')} as climatology, {q6(f'case when sd > 0 then ({a}) / sd end' if standard else a)} as anomaly from c"""


@query(_anomaly_sql(False))
def seasonal_anomalies(spark, sf):
    long, n = lineitem_long(spark, sf, 400)
    return rounded(anomaly.anomalies(long, n, 4, start_position=2))


@query(_anomaly_sql(True))
def standardised_anomalies(spark, sf):
    long, n = lineitem_long(spark, sf, 400)
    return rounded(anomaly.anomalies(long, n, 4, start_position=2, standardise=True))


@query(f"""with {long_sql(100)}
p as (select cell, value, lag(value) over (partition by cell order by t) as b from series)
select cell, {q6('case when stddev_samp(value) > 0 and stddev_samp(b) > 0 then corr(value, b) end')} as r from p where b is not null group by cell""")
def residual_autocorrelation(spark, sf):
    long, n = lineitem_long(spark, sf, 100)
    complete = long.groupBy("grid_id", "cell").count().where(F.col("count") == n).drop("count")
    return rounded(slope.residual_autocorrelation(long.join(complete, ["grid_id", "cell"])))


# ------------------------------------------------------------------ spatial operators


def _field(spark, sf, cells: int = 100) -> tuple[DataFrame, Stack]:
    """The slope of each cell as a field x; incomplete cells have none."""
    stack = lineitem_stack(spark, sf, cells)
    return slope.slope_estimator(stack, "OLS").withColumnRenamed("slope", "x"), stack


FIELD = FIT + "field as (select cells.cell, row, col, slope as x from cells left join ols using (cell)),"


@query(f"with {long_sql(400)}{neighbours_sql()} x as (select 1) select nbr.cell, nbr from nbr join cells a on a.cell = nbr.cell join cells b on b.cell = nbr.nbr where a.ok and b.ok")
def neighbour_edges(spark, sf):
    stack = lineitem_stack(spark, sf, 400)
    return spatial.edges(stack.cells, spatial.neighbourhood(stack.spec)).select("cell", "nbr")


@query(f"with {long_sql(400)}{neighbours_sql(reach=2, rook=True)} x as (select 1) select nbr.cell, nbr from nbr join cells a on a.cell = nbr.cell join cells b on b.cell = nbr.nbr where a.ok and b.ok")
def neighbour_edges_rook(spark, sf):
    stack = lineitem_stack(spark, sf, 400)
    return spatial.edges(stack.cells, spatial.neighbourhood(stack.spec, "rook", 5)).select("cell", "nbr")


@query(f"with {long_sql(100)}{cmk_sql()} x as (select 1) {CELLS}, {q6('Sm')} as \"Sm\", {q6('VarSm', 4)} as \"VarSm\", {q6('p')} as p {AT} cmk using (cell)")
def contextual_mann_kendall(spark, sf):
    rows = trend.trend_test(lineitem_stack(spark, sf), "CMK")
    return rows.select("cell", "row", "col", "ok", r6("Sm").alias("Sm"), r6("VarSm", 4).alias("VarSm"), r6("p").alias("p"))


@query(f"with {long_sql(400, 'quarter', 2000)}{cmk_sql(2, True, True)} x as (select 1) {CELLS}, {q6('Sm')} as \"Sm\", {q6('VarSm', 4)} as \"VarSm\", {q6('p')} as p {AT} cmk using (cell)")
def contextual_mann_kendall_rook_ties(spark, sf):
    rows = trend.trend_test(lineitem_stack(spark, sf, 400, step=2000), "CMK", window_size=5, connectivity="rook", continuity=True)
    return rows.select("cell", "row", "col", "ok", r6("Sm").alias("Sm"), r6("VarSm", 4).alias("VarSm"), r6("p").alias("p"))


LAGGED = """
zf as (select cell, x as raw, x - avg(x) over () as z from field where x is not null),
wz as (select a.cell, a.z, a.raw, coalesce(sum(b.z), 0) as wz, coalesce(sum(b.raw), 0) as wr, count(b.z) as k from zf a left join nbr on nbr.cell = a.cell left join zf b on b.cell = nbr.nbr group by a.cell, a.z, a.raw),"""


@query(f"with {long_sql(400)}{FIELD}{neighbours_sql()}{LAGGED} x as (select 1) select {q6('count(*) / sum(k)::double * sum(z * wz) / sum(z * z)')} as statistic, count(*) as n, sum(k)::bigint as s0 from wz")
def moran_global(spark, sf):
    field, stack = _field(spark, sf, 400)
    return rounded(spatial.global_statistic(field, stack.spec))


POSITIVE = "mom as (select cell, avg(value) as x from series group by cell), field as (select cells.cell, row, col, x from cells left join mom using (cell)),"


def _level(spark, sf, cells: int = 100) -> tuple[DataFrame, Stack]:
    stack = lineitem_stack(spark, sf, cells)
    return stack.cells.select("grid_id", "cell", "row", "col", when_ok(S.mean(F.col("y"))).alias("x")), stack


@query(f"with {long_sql(400)}{POSITIVE}{neighbours_sql()}{LAGGED} x as (select 1) select {q6('sum(raw * wr) / (sum(raw) * sum(raw) - sum(raw * raw))', 9)} as statistic, count(*) as n, sum(k)::bigint as s0 from wz")
def getis_ord_global(spark, sf):
    field, stack = _level(spark, sf, 400)
    return rounded(spatial.global_statistic(field, stack.spec, method="getis_ord"), 9)


@query(f"with {long_sql(400)}{FIELD}{neighbours_sql()}{LAGGED} m as (select sum(z * z) / count(*) as m2 from wz) select cell, {q6('case when k > 0 then z * wz / m2 end')} as statistic, case when k = 0 then null when abs(z * wz / m2) < 0.1 then 'low' when abs(z * wz / m2) < 0.3 then 'moderate' else 'strong' end as magnitude from wz, m")
def moran_local(spark, sf):
    field, stack = _field(spark, sf, 400)
    return rounded(spatial.local_statistic(field, stack.spec).withColumn("magnitude", spatial.moran_class(F.col("statistic"))))


@query(f"with {long_sql(400)}{POSITIVE}{neighbours_sql(rook=True)}{LAGGED} m as (select sum(raw) as t from wz) select cell, {q6('case when k > 0 then (wr + raw) / t end', 9)} as statistic from wz, m")
def getis_ord_local(spark, sf):
    field, stack = _level(spark, sf, 400)
    return rounded(spatial.local_statistic(field, stack.spec, method="getis_ord", connectivity="rook"), 9)


@query(f"with {long_sql(400)}{FIELD}{neighbours_sql(include_self=True)} f as (select nbr.cell, quantile_cont(b.x, 0.5) as m from nbr join field b on b.cell = nbr.nbr group by nbr.cell) select a.cell, {q6('case when a.x is not null then m end')} as x from field a join f using (cell)")
def focal_median(spark, sf):
    field, stack = _field(spark, sf, 400)
    return rounded(spatial.focal_median(field, "x", stack.spec).select("cell", "x"))


@query(f"with {long_sql(100)}{neighbours_sql(reach=2, include_self=True)} x as (select 1) select nbr.cell, t::int as t, {q6('avg(value)')} as value from nbr join long on long.cell = nbr.nbr group by 1, 2")
def focal_mean(spark, sf):
    long, n = lineitem_long(spark, sf, 100)
    spec = lineitem_stack(spark, sf).spec
    rows = long.withColumn("row", spec.row(F.col("cell"))).withColumn("col", spec.col(F.col("cell")))
    full = spark.range(1, 101).crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "t")).select(F.lit("g").alias("grid_id"), F.col("id").alias("cell"), F.col("t").cast("int").alias("t"))
    rows = full.join(rows.drop("row", "col"), ["grid_id", "cell", "t"], "left").withColumn("row", spec.row(F.col("cell"))).withColumn("col", spec.col(F.col("cell")))
    return rounded(spatial.focal_mean(rows, "value", spec, 5).select("cell", "t", "value").where("value is not null"))


@query(f"with {long_sql(100)}{neighbours_sql(include_self=True)} x as (select 1) select t::int as t, {q6('quantile_cont(value, 0.5)')} as value from nbr join long on long.cell = nbr.nbr where nbr.cell = 45 group by 1")
def neighbourhood_series(spark, sf):
    stack = lineitem_stack(spark, sf)
    return rounded(inspect.aggregate_series(stack, inspect.neighbours_of(stack, 45)).where("value is not null"))


# ------------------------------------------------------------------ multiple testing

PVALUES = "src as (select cell as id, p from mk),"


def _pvalues(spark, sf) -> DataFrame:
    return trend.trend_test(lineitem_stack(spark, sf), "MK", ties=True)


@query(f"with {long_sql(100)}{MK}{PVALUES}{fdr_sql('src', 0.2)} x as (select 1) select id as cell, {q6('p')} as p, p <= 0.2 as reject_raw, {q6('bh')} as \"q_BH\", bh <= 0.2 as \"reject_BH\", {q6('by_')} as \"q_BY\", by_ <= 0.2 as \"reject_BY\", {q6('bky')} as \"q_BKY\", bky <= 0.2 as \"reject_BKY\" from bky")
def fdr_methods(spark, sf):
    rows = fdr.correct(_pvalues(spark, sf).where("ok").select("grid_id", "cell", "p"), ("BH", "BY", "BKY"), 0.2)
    return rounded(rows.select("cell", "p", "reject_raw", "q_BH", "reject_BH", "q_BY", "reject_BY", "q_BKY", "reject_BKY"))


def _original_sql(q: float) -> str:
    first = q / (1 + q)
    return f"""with {long_sql(100)}{MK}{PVALUES}{fdr_sql('src', q)}
k as (select max(case when p <= r / m::double * ({first!r} * m / (m - r1)) then r end) as k from bky where r1 > 0 and m > r1)
select id as cell, {q6('p')} as p, case when r1 = 0 then false when r1 = m then true else r <= coalesce(k, 0) end as reject from bky, k"""


@query(_original_sql(0.3))
def fdr_bky_original(spark, sf):
    rows = fdr.apply(_pvalues(spark, sf).where("ok").select("grid_id", "cell", "p"), "BKY", 0.3, "original")
    return rounded(rows.select("cell", "p", "reject"))


@query(f"with {long_sql(100)}{MK}{PVALUES}{fdr_sql('src', 0.05)} x as (select 1) select distinct {q6('p', 9)} as p, r as rank, {q6('r / m::double * 0.05')} as bh_line, {q6('r / m::double * 0.05 / pi0')} as bky_line from bky")
def fdr_thresholds(spark, sf):
    rows = fdr.thresholds(_pvalues(spark, sf).where("ok").select("grid_id", "cell", "p"))
    return rows.select(r6("p", 9).alias("p"), "rank", r6("bh_line").alias("bh_line"), r6("bky_line").alias("bky_line"))


@query(f"with {long_sql(100)}{MK}{PVALUES}{fdr_sql('src', 0.3)} x as (select 1) select coalesce(max(case when p <= r / m::double * 0.3 then r end), 0)::bigint as bh_cutoff, coalesce(max(case when p <= r / m::double * 0.3 / pi0 then r end), 0)::bigint as bky_cutoff from bky")
def fdr_cutoffs(spark, sf):
    return fdr.cutoffs(_pvalues(spark, sf).where("ok").select("grid_id", "cell", "p"), 0.3).drop("grid_id")


# ------------------------------------------------------------------ permutations

PERM = f"""
vals as (select cell, x, row_number() over (order by cell) - 1 as i from field where x is not null),
{permute_sql("(select perm, i, (select count(*) from vals) as n from vals, range(1, 50) u(perm))", 1)},
maps as (select perm, a.cell, b.x from walk join vals a on a.i = walk.i join vals b on b.i = walk.v where v < n),"""


def _perm_global_sql() -> str:
    return f"""with recursive {long_sql(100)}{FIELD}{neighbours_sql()}{PERM}
allm as (select * from maps union all select 0, cell, x from field where x is not null),
zf as (select perm, cell, x - avg(x) over (partition by perm) as z from allm),
w as (select a.perm, sum(a.z * b.z) as zwz, count(*) as s0 from zf a join nbr on nbr.cell = a.cell join zf b on b.cell = nbr.nbr and b.perm = a.perm group by a.perm),
q as (select perm, sum(z * z) as zz, count(*) as n from zf group by perm),
st as (select perm, n / s0::double * zwz / zz as i, n, s0 from w join q using (perm)),
o as (select i as obs, n as n0, s0 as k0 from st where perm = 0)
select {q6('any_value(obs)')} as statistic, any_value(n0) as n, any_value(k0)::bigint as s0, {q6('min(i)')} as null_min, {q6('avg(i)')} as null_mean, {q6('stddev_samp(i)')} as null_sd, {q6('max(i)')} as null_max,
  {q6('(count(*) filter (i >= obs - 1e-12 * abs(obs)) + 1) / 50.0::double')} as p, {q6('(any_value(obs) - avg(i)) / stddev_samp(i)')} as z, {q6('1 / 50.0::double')} as p_floor,
  case when abs(any_value(obs)) < 0.1 then 'low' when abs(any_value(obs)) < 0.3 then 'moderate' else 'strong' end as magnitude
from st, o where perm > 0"""


@query(_perm_global_sql())
def permutation_global(spark, sf):
    field, stack = _field(spark, sf)
    return rounded(permutation.global_test(field, stack.spec, nperm=49))


def _perm_local_sql() -> str:
    return f"""with recursive {long_sql(100)}{FIELD}{neighbours_sql()}{PERM}
allm as (select * from maps union all select 0, cell, x from field where x is not null),
zf as (select perm, cell, x - avg(x) over (partition by perm) as z from allm),
m as (select perm, sum(z * z) / count(*) as m2 from zf group by perm),
li as (select a.perm, a.cell, any_value(a.z) * sum(b.z) / any_value(m2) as i from zf a join nbr on nbr.cell = a.cell join zf b on b.cell = nbr.nbr and b.perm = a.perm join m on m.perm = a.perm group by a.perm, a.cell),
o as (select cell, i as statistic from li where perm = 0),
mo as (select cell, avg(i) as null_mean, stddev_samp(i) as null_sd from li where perm > 0 group by cell),
h as (select li.cell, count(*) filter (abs(i - null_mean) >= abs(statistic - null_mean) - 1e-12 * greatest(abs(statistic), abs(i))) as hits from li join o using (cell) join mo using (cell) where perm > 0 group by li.cell)
select cell, {q6('statistic')} as statistic, {q6('null_mean')} as null_mean, {q6('null_sd')} as null_sd, {q6('(statistic - null_mean) / null_sd')} as z, {q6('(hits + 1) / 50.0::double')} as p, (hits + 1) / 50.0::double <= 0.05 as significant
from o join mo using (cell) join h using (cell)"""


@query(_perm_local_sql())
def permutation_local(spark, sf):
    field, stack = _field(spark, sf)
    return rounded(permutation.local_test(field, stack.spec, nperm=49))


@query(f"""with recursive {long_sql(100)}{FIELD}{neighbours_sql()}{PERM}
zf as (select perm, cell, x - avg(x) over (partition by perm) as z from maps),
w as (select a.perm, sum(a.z * b.z) as zwz, count(*) as s0 from zf a join nbr on nbr.cell = a.cell join zf b on b.cell = nbr.nbr and b.perm = a.perm group by a.perm),
q as (select perm, sum(z * z) as zz, count(*) as n from zf group by perm),
st as (select perm, n / s0::double * zwz / zz as i from w join q using (perm)),
sp as (select min(i) as lo, (max(i) - min(i)) / 20 as width from st),
b as (select least(20, floor((i - lo) / width) + 1)::int as bin, lo, width, count(*) as n from st, sp group by 1, 2, 3)
select bin, {q6('lo + (bin - 1) * width')} as lower, {q6('lo + bin * width')} as upper, n from b""")
def permutation_null_histogram(spark, sf):
    field, stack = _field(spark, sf)
    return rounded(permutation.null_histogram(permutation.null_statistics(field, stack.spec, "x", "moran", 49, 1)))


@query(f"""with l as ({_perm_local_sql()})
select 'moran' as method, 'local' as scope, 'two.sided' as alternative, count(*) as "N", count(statistic) as "N_tested", 49 as nperm, min(statistic) as statistic_min, {q6('quantile_cont(statistic, 0.5)')} as statistic_median,
  max(statistic) as statistic_max, min(p) as raw_p_min, 0.05::double as alpha, count(*) filter (significant) as n_significant_raw, round(100.0 * count(*) filter (significant) / count(statistic), 2)::double as pct_significant_raw from l""")
def permutation_local_summary(spark, sf):
    field, stack = _field(spark, sf)
    return rounded(permutation.local_summary(permutation.local_test(field, stack.spec, nperm=49), "moran", nperm=49))


def _advice_sql() -> str:
    return f"""with recursive {long_sql(100)}{MK}{neighbours_sql()} field as (select cells.cell, row, col, p as x from cells left join mk using (cell)),{PERM}
allm as (select * from maps union all select 0, cell, x from field where x is not null),
zf as (select perm, cell, x - avg(x) over (partition by perm) as z from allm),
w as (select a.perm, sum(a.z * b.z) as zwz, count(*) as s0 from zf a join nbr on nbr.cell = a.cell join zf b on b.cell = nbr.nbr and b.perm = a.perm group by a.perm),
q as (select perm, sum(z * z) as zz, count(*) as n from zf group by perm),
st as (select perm, n / s0::double * zwz / zz as i from w join q using (perm)),
o as (select i as obs from st where perm = 0),
r as (select any_value(obs) as statistic, (count(*) filter (i >= obs - 1e-12 * abs(obs)) + 1) / 50.0::double as p from st, o where perm > 0)
select {q6('statistic')} as statistic, {q6('p')} as p, case when statistic >= 0 and p < 0.05 then 'BH' end as recommendation, case when statistic >= 0 and p < 0.05 then 'positive dependence' else 'inconclusive' end as finding from r"""


@query(_advice_sql())
def fdr_moran_advice(spark, sf):
    stack = lineitem_stack(spark, sf)
    return rounded(permutation.moran_advice(trend.trend_test(stack, "MK"), stack.spec, nperm=49))


# ------------------------------------------------------------------ directions and reports

ALL = f"{MK}{SEN}{PVALUES}{fdr_sql('src', 0.3)} al as (select b.id as cell, b.p, mk.S, slope, bh <= 0.3 as rj_bh, bky <= 0.3 as rj_bky from bky b join mk on mk.cell = b.id join sen on sen.cell = b.id),"
DIR = "case when {r} and slope > 0 then 1 when {r} and slope < 0 then -1 else 0 end"


def _decided(spark, sf) -> tuple[DataFrame, Stack]:
    stack = lineitem_stack(spark, sf)
    rows = trend.trend_test(stack, "MK").join(slope.slope_estimator(stack).select("grid_id", "cell", "slope"), ["grid_id", "cell"]).where("ok")
    return fdr.correct(rows, ("BH", "BKY"), 0.3), stack


@query(f"with {long_sql(100)}{ALL} x as (select 1) select cell, {DIR.format(r='rj_bh')} as \"direction_BH\", {DIR.format(r='rj_bky')} as \"direction_BKY\", {q6('case when rj_bky then slope end')} as slope_masked, sign(slope)::int as sign from al")
def direction_maps(spark, sf):
    rows, _ = _decided(spark, sf)
    rows = direction_map(rows, ("BH", "BKY"))
    return rows.select("cell", "direction_BH", "direction_BKY", r6(F.when(F.col("reject_BKY"), F.col("slope"))).alias("slope_masked"), F.signum("slope").cast("int").alias("sign"))


@query(f"with {long_sql(100)}{ALL} k as (select cell, case when rj_bky then slope end as x from al), {neighbours_sql(include_self=True)} f as (select nbr.cell, quantile_cont(b.x, 0.5) as m from nbr join k b on b.cell = nbr.nbr group by nbr.cell) select k.cell, {q6('case when k.x is not null then m end')} as slope_masked from k left join f using (cell)")
def masked_smoothed_slope(spark, sf):
    rows, stack = _decided(spark, sf)
    return rounded(smoothed_masked_slope(rows, stack.spec).select("cell", "slope_masked"))


@query(f"with {long_sql(100)}{SEN} x as (select 1) select {q6('-least(max(abs(slope)), 2 * stddev_samp(slope))')} as lower, {q6('least(max(abs(slope)), 2 * stddev_samp(slope))')} as upper from sen")
def slope_range(spark, sf):
    return rounded(robust_range(slope.slope_estimator(lineitem_stack(spark, sf)), "slope"))


@query(f"with {long_sql(100)}{MK} a(alpha) as (values (0.01::double), (0.05::double), (0.1::double)) select alpha, count(*) filter (p <= alpha) as n_significant, count(*) filter (p > alpha) as n_not_significant, count(*) as n_valid, count(*) filter (p <= alpha and S > 0) as n_increase, count(*) filter (p <= alpha and S < 0) as n_decrease, round(100 * count(*) filter (p <= alpha) / count(*)::double, 2) as pct, alpha = 0.05 as reference from mk, a group by alpha")
def trend_summary(spark, sf):
    return report.trend_summary(_pvalues(spark, sf), (0.01, 0.05, 0.1)).drop("grid_id")


@query(f"""with {long_sql(100)}{ALL} c as (select 'raw' as procedure, p <= 0.3 as r from al union all select 'BH', rj_bh from al union all select 'BKY', rj_bky from al)
select procedure, count(*) filter (r) as n_rejected, count(*) filter (not r) as n_not_rejected, count(*) as n_valid, round(100 * count(*) filter (r) / count(*)::double, 3) as pct from c group by procedure""")
def fdr_summary(spark, sf):
    return report.fdr_summary(_decided(spark, sf)[0]).drop("grid_id")


@query(f"""with {long_sql(100)}{ALL} c as (select 'BH' as procedure, {DIR.format(r='rj_bh')} as d from al union all select 'BKY', {DIR.format(r='rj_bky')} from al)
select procedure, count(*) filter (d = 1) as n_increase, count(*) filter (d = -1) as n_decrease, count(*) filter (d = 0) as n_ns, count(*) as n_valid,
  round(100 * count(*) filter (d = 1) / count(*)::double, 3) as pct_increase, round(100 * count(*) filter (d = -1) / count(*)::double, 3) as pct_decrease, round(100 * count(*) filter (d = 0) / count(*)::double, 3) as pct_ns from c group by procedure""")
def fdr_direction_summary(spark, sf):
    return report.fdr_direction_summary(_decided(spark, sf)[0], source="slope").drop("grid_id")


@query(f"""with {long_sql(400)}{SEN} x as (select 1)
select count(*) as n_valid, round(min(slope), 6) as min, round(quantile_cont(slope, 0.5), 6) as median, round(avg(slope), 6) as mean, round(max(slope), 6) as max, count(*) filter (slope > 0) as n_increasing, count(*) filter (slope < 0) as n_decreasing, count(*) filter (slope = 0) as n_flat,
  round(100 * count(*) filter (slope > 0) / count(*)::double, 2) as pct_increasing, round(100 * count(*) filter (slope < 0) / count(*)::double, 2) as pct_decreasing, round(100 * count(*) filter (slope = 0) / count(*)::double, 2) as pct_flat from sen""")
def slope_summary(spark, sf):
    return report.slope_summary(slope.slope_estimator(lineitem_stack(spark, sf, 400))).drop("grid_id")


@query(f"""with {long_sql(100)}{VCTFPW} x as (select 1)
select count(*) as n_valid, count(*) filter (ch) as n_prewhitened, {q6('avg(case when ch then rho end)')} as mean_rho, round(100 * count(*) filter (ch) / count(*)::double, 2) as pct from (select nb.ch, sc.rho from nb join sc using (cell))""")
def prewhiten_summary(spark, sf):
    return rounded(report.prewhiten_summary(prewhiten.prewhiten(lineitem_stack(spark, sf), "VCTFPW")[1]))


@query(f"""with {long_sql(100)}{TFPW_Y} v as (select slope, rho from sen join rh using (cell)), c as (select 'Beta_TheilSen' as name, slope as x from v union all select 'Rho', rho from v)
select name, count(*) as n, {q6('min(x)')} as min, {q6('quantile_cont(x, 0.25)')} as q1, {q6('quantile_cont(x, 0.5)')} as median, {q6('avg(x)')} as mean, {q6('quantile_cont(x, 0.75)')} as q3, {q6('max(x)')} as max from c group by name""")
def tfpw_summary(spark, sf):
    return rounded(report.tfpw_y_summary(prewhiten.prewhiten(lineitem_stack(spark, sf), "TFPW_Y")[1]))


@query(f"with {long_sql(100)}{ALL} c as (select {DIR.format(r='rj_bky')} as direction from al) select direction, count(*) as n from c group by direction")
def direction_counts(spark, sf):
    return report.direction_counts(direction_map(_decided(spark, sf)[0], ("BKY",), "slope"), "direction_BKY").drop("grid_id")


@query(f"with {long_sql(100)}{MK} b as (select least(40, floor(p / 0.025::double) + 1)::int as bin, count(*) as n from mk group by 1) select bin, {q6('(bin - 1) * 0.025::double')} as lower, {q6('bin * 0.025::double')} as upper, n from b")
def p_histogram(spark, sf):
    return rounded(report.trend_histograms(_pvalues(spark, sf).where("ok")))


@query(f"with {long_sql(100)}{MK} b as (select least(20, floor(p / 0.05::double) + 1)::int as bin, count(*) as n from mk group by 1) select bin, {q6('(bin - 1) * 0.05::double')} as lower, {q6('bin * 0.05::double')} as upper, n from b")
def fdr_histogram(spark, sf):
    return rounded(report.fdr_histogram(_pvalues(spark, sf).where("ok")))


@query(f"with {long_sql(100)}{MK} x as (select 1) select row, col, 'S' as panel, S as value from cells left join mk using (cell) union all select row, col, 'p', {q6('p')} from cells left join mk using (cell)")
def trend_map_panels(spark, sf):
    return rounded(report.map_panel(_pvalues(spark, sf), ("S", "p")))


# ------------------------------------------------------------------ detection scores

DETECT = f"""
tr as (select cell, cell % 3 = 0 as signal, (case when cell % 2 = 0 then 1 else -1 end) as td from cells),
de as (select m.method, r.replicate, c.cell, ((c.cell * 7 + r.replicate * 11 + m.k * 5) % 10) < m.k and (m.method <> 'false' or c.cell % 3 <> 0) as significant, (case when (c.cell + r.replicate) % 5 = 0 then -1 else 1 end) as d from cells c, (values ('loose', 5), ('strict', 2), ('wide', 5), ('none', 0), ('false', 6)) m(method, k), (values (1), (2), (3)) r(replicate)),
j as (select * from de join tr using (cell)),
cf as (select method, replicate, count(*) filter (significant and signal)::double as tp, count(*) filter (significant and not signal)::double as fp, count(*) filter (not significant and not signal)::double as tn, count(*) filter (not significant and signal)::double as fn,
  count(*) filter (significant and signal and d = td)::double as rt, count(*) filter (significant and signal and d <> td)::double as wr from j group by method, replicate),
ms as (select method, replicate, tp, fp, tn, fn, tp / (tp + fn) as "Sensitivity", tn / (tn + fp) as "Specificity", tp / nullif(tp + fp, 0) as "Precision", (tp + tn) / (tp + fp + tn + fn) as "Accuracy", case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end as "F1",
  (tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0) as "MCC", fp / (fp + tn) as "FPR", case when tp + fp = 0 then 0 else fp / (tp + fp) end as "FDR", fn / (tp + fn) as "TypeII", wr / nullif(tp, 0) as "TypeIII", rt / (tp + fn) as "DirectionalPower", (tp > 0)::double as "GlobalPower" from cf),"""
SHOWN = ("Sensitivity", "Specificity", "Precision", "Accuracy", "F1", "MCC", "FPR", "FDR", "TypeII", "TypeIII", "DirectionalPower", "GlobalPower")


def _detections(spark, sf) -> tuple[DataFrame, DataFrame]:
    cells = lineitem_stack(spark, sf).cells.select("cell")
    truth = cells.select("cell", (F.col("cell") % 3 == 0).alias("signal"), F.when(F.col("cell") % 2 == 0, 1).otherwise(-1).alias("direction"))
    methods = F.array(*(F.struct(F.lit(n).alias("method"), F.lit(k).alias("k")) for n, k in (("loose", 5), ("strict", 2), ("wide", 5), ("none", 0), ("false", 6))))  # none finds nothing, false only what is not there
    rows = cells.withColumn("m", F.explode(methods)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(3))))
    hit = (F.col("cell") * 7 + F.col("replicate") * 11 + F.col("m.k") * 5) % 10 < F.col("m.k")
    hit = hit & ((F.col("m.method") != "false") | (F.col("cell") % 3 != 0))
    return rows.select("m.method", "replicate", "cell", hit.alias("significant"), F.when((F.col("cell") + F.col("replicate")) % 5 == 0, -1).otherwise(1).alias("direction")), truth


@query(f"with {long_sql(100)}{DETECT} x as (select 1) select method, tp::bigint as \"TP\", fp::bigint as \"FP\", tn::bigint as \"TN\", fn::bigint as \"FN\", " + ", ".join(f"{q6(chr(34) + c + chr(34))} as \"{c}\"" for c in SHOWN) + " from ms where replicate = 1")
def detection_scores(spark, sf):
    found, truth = _detections(spark, sf)
    return rounded(scoring.compare_detections(found.where("replicate = 1").drop("replicate"), truth, SHOWN))


@query(f"with {long_sql(100)}{DETECT} x as (select 1) select method, count(*) as n_replicates, " + ", ".join(f"{q6(f'avg({chr(34)}{c}{chr(34)})')} as \"{c}_mean\", {q6(f'stddev_samp({chr(34)}{c}{chr(34)})')} as \"{c}_sd\"" for c in SHOWN) + f", {q6('avg((fp > 0)::double)')} as \"FWER\" from ms group by method")
def detection_replicates(spark, sf):
    found, truth = _detections(spark, sf)
    return rounded(scoring.compare_detections(found, truth, SHOWN))


@query(f"""with {long_sql(100)}{DETECT} u as (unpivot (select method, "Sensitivity", "FPR", "MCC" from ms where replicate = 1 and method in ('wide', 'loose', 'strict')) on "Sensitivity", "FPR", "MCC" into name metric value value),
k as (select *, row_number() over (partition by metric order by case when metric = 'FPR' then value else -value end, list_position(['wide', 'loose', 'strict'], method)) as i from u)
select metric, method, {q6('value')} as value from k where i = 1""")
def best_methods(spark, sf):
    found, truth = _detections(spark, sf)
    scores = scoring.compare_detections(found.where("replicate = 1 and method in ('wide', 'loose', 'strict')").drop("replicate"), truth, SHOWN)
    return rounded(scoring.best_methods(scores, ("Sensitivity", "FPR", "MCC"), ("wide", "loose", "strict")))


@query(f"""with {long_sql(100)}{SEN}{FIT} e as (select o.slope as a, s.slope as b from ols o join sen s using (cell))
select {q6('avg(b - a)')} as "Bias", {q6('avg(abs(b - a))')} as "MAE", {q6('sqrt(avg((b - a) * (b - a)))')} as "RMSE", {q6('avg((sign(a) <> sign(b))::int::double)')} as "DirectionError" from e""")
def slope_errors(spark, sf):
    stack = lineitem_stack(spark, sf)
    truth = slope.slope_estimator(stack, "OLS").select("grid_id", "cell", F.col("slope").alias("true_slope"))
    return rounded(scoring.slope_scores(slope.slope_estimator(stack).join(truth, ["grid_id", "cell"]), ("grid_id",)))


# ------------------------------------------------------------------ simulation and benchmarks


@query("""select 'S' || lpad((i + 1)::varchar, 2, '0') as scenario, [0.0::double, 0.1, 0.2][i % 3 + 1] as trend_strength, [0.0::double, 0.5][i // 3 % 2 + 1] as ar1, 12 as n_time from range(6) u(i)""")
def simulation_design(spark, sf):
    return simulate.simulation_design(spark, {"trend_strength": [0.0, 0.1, 0.2], "ar1": [0.0, 0.5]}, {"n_time": 12})


@query("select * from (values ('trend_strength', 3::bigint), ('ar1', 2::bigint), ('n_time', 1::bigint)) v(factor, levels)")
def simulation_design_summary(spark, sf):
    return simulate.design_summary(simulation_design(spark, sf))


@query(f"""with c as (select i as cell, (i - 1) // 12 + 1 as row, (i - 1) % 12 + 1 as col from range(1, 121) u(i)), t as (select k as t from range(1, 9) u(k)),
s as (select *, row <= 2 and col <= 2 as k0, 0.2::double * (col - 6.5) / 5.5::double as g from c)
select cell, t::int as t, {q6('case when k0 then 5.0::double else g * t + 10 end')} as value, {q6('case when k0 then 0.0::double else g end')} as true_slope, (case when k0 then 0 else sign(g) end)::int as true_direction from s, t""")
def simulated_gradient(spark, sf):
    s = simulate.Scenario(nrow=10, ncol=12, n_time=8, trend_strength=0.2, trend_shape="gradient", trend_fraction=1.0, noise_sd=0.0, seed=4)
    sim = simulate.simulate(spark, s)
    # signs of whole blocks are turned by hash; magnitudes and the sign of the plain gradient are compared
    plain = F.when((F.col("row") <= 2) & (F.col("col") <= 2), F.lit(0.0)).otherwise(F.lit(0.2) * (F.col("col") - 6.5) / 5.5)
    rows = sim.long.join(sim.truth, ["grid_id", "cell"]).withColumn("turn", F.when(F.signum("true_slope") == F.signum(plain), 1.0).otherwise(-1.0))
    value = F.when((F.col("row") <= 2) & (F.col("col") <= 2), F.col("value")).otherwise((F.col("value") - 10) * F.col("turn") + 10)
    return rows.select("cell", "t", r6(value).alias("value"), r6(F.col("true_slope") * F.col("turn")).alias("true_slope"), F.signum(F.col("true_slope") * F.col("turn")).cast("int").alias("true_direction"))


@query(f"""with c as (select i as cell, (i - 1) // 12 + 1 as row, (i - 1) % 12 + 1 as col from range(1, 145) u(i)), t as (select k as t from range(1, 9) u(k)),
s as (select cell, row, col, case when abs(col - 6.5) <= 3 and abs(row - 6.5) <= 3 then 0.3::double else 0.0::double end as g from c)
select cell, t::int as t, {q6('g * t + 10')} as value from s, t""")
def simulated_square(spark, sf):
    s = simulate.Scenario(nrow=12, ncol=12, n_time=8, trend_strength=0.3, trend_shape="square", signal_size=(0.5,), noise_sd=0.0, constant_block=False)
    return rounded(simulate.simulate(spark, s).long)


@query()
def simulated_noise(spark, sf):
    return rounded(simulate.simulate(spark, simulate.Scenario(nrow=12, ncol=12, n_time=12, ar1=0.5, break_type="mean")).long)


@query()
def simulated_spatial_field(spark, sf):
    return rounded(simulate.simulate(spark, simulate.Scenario(nrow=16, ncol=16, n_time=6, spatial_model="exponential", spatial_rho=0.65)).long)


@query()
def simulation_summary(spark, sf):
    return rounded(report.simulation_summary(simulate.simulate(spark, simulate.Scenario(trend_shape="block")).truth))


def _benchmarked(spark) -> DataFrame:
    scenarios = {"null": simulate.Scenario(nrow=8, ncol=8, n_time=12, trend_strength=0.0, smooth_radius=0), "signal": simulate.Scenario(nrow=8, ncol=8, n_time=12, trend_strength=0.5, smooth_radius=0)}

    def test(method):
        def run(stack, sim):
            rows = trend.trend_test(stack, method)
            return rows.select("grid_id", "cell", (F.col("p") <= 0.05).alias("significant"), F.signum(trend.SCHEMAS[method][0]).cast("int").alias("direction"))

        return run

    return benchmark.benchmark_methods(spark, scenarios, {"MK": test("MK"), "CMK": test("CMK")}, 3, "fdr")


@query()
def benchmark_rows(spark, sf):
    return rounded(_benchmarked(spark).drop("Elapsed"))


@query()
def benchmark_summaries(spark, sf):
    return rounded(benchmark.benchmark_summary(_benchmarked(spark).drop("Elapsed")))


@query()
def benchmark_plot(spark, sf):
    return rounded(benchmark.benchmark_plot_table(_benchmarked(spark), "EmpiricalFDR", "ci"))


# ------------------------------------------------------------------ ingest and calendars


@query(f"""with l as (select {UNITS['quarter']} as k, min(date_trunc('quarter', l_shipdate))::date as time, sum(cast(round(l_extendedprice * 100) as bigint))::double / 100 as value from lineitem group by 1)
select 1 as row, 1 as col, (dense_rank() over (order by time))::int as t, time, {q6('value', 2)} as value from l""")
def layers_from_cubes(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100
    cube = items.groupBy(F.trunc("l_shipdate", "quarter").alias("time")).agg(cents.alias("price")).select(F.lit(1).alias("row"), F.lit(1).alias("col"), "time", "price")
    return long_from_cubes(cube).select("row", "col", "t", "time", r6("value", 2).alias("value"))


def _calendar_sql(cycle: str) -> str:
    keys = {
        "8-day": "(year(d), (dayofyear(d) - 1) // 8)", "semimonthly": "(year(d), month(d) * 2 + (case when day(d) > 15 then 1 else 0 end))",
        "10-day": "(year(d), month(d) * 3 + least((day(d) - 1) // 10, 2))", "monthly": "(year(d), month(d))", "16-day": "(year(d), (dayofyear(d) - 1) // 16)",
        "weekly": "(year(d), (dayofyear(d) - 1) // 7)",
    }
    skip = " where dayofyear(d) <= 364" if cycle == "weekly" else ""
    return f"""with days as (select cast(d as date) as d from generate_series(date '2019-01-01', date '2021-12-31', interval 1 day) u(d)), p as (select min(d) as start, max(d) as "end" from days{skip} group by {keys[cycle]})
select '{cycle}' as cycle, start, "end", (start + (datediff('day', start, "end") // 2)::int)::date as centre from p"""


@query(" union all ".join(f"({_calendar_sql(c)})" for c in ("monthly", "semimonthly", "10-day", "16-day", "8-day", "weekly")))
def calendar_periods(spark, sf):
    from datetime import date

    out = None
    for c in ("monthly", "semimonthly", "10-day", "16-day", "8-day", "weekly"):
        rows = calendar.calendar_frame(spark, c, date(2019, 1, 1), date(2021, 12, 31)).select(F.lit(c).alias("cycle"), "start", "end", "centre")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------------ workflows


def _rta_sql(q: float) -> str:
    return f"""with {long_sql(100)}{cmk_sql()}{SEN} src as (select cell as id, p from cmk),{fdr_sql('src', q)}
o as (select b.id as cell, b.p, bh, slope, Sm, VarSm, bh <= {q} as rj from bky b join cmk on cmk.cell = b.id join sen on sen.cell = b.id)
{CELLS}, {q6('Sm')} as "Sm", {q6('VarSm', 4)} as "VarSm", {q6('o.p')} as p, {q6('slope')} as slope, {q6('bh')} as "q_BH", rj as "reject_BH", case when rj is null then null when rj and slope > 0 then 1 when rj and slope < 0 then -1 else 0 end as "direction_BH" {AT} o using (cell)"""


@query(_rta_sql(0.2))
def workflow_robust_trends(spark, sf):
    out = workflow_rta(lineitem_stack(spark, sf), q=0.2).cells
    return out.select("cell", "row", "col", "ok", r6("Sm").alias("Sm"), r6("VarSm", 4).alias("VarSm"), r6("p").alias("p"), r6("slope").alias("slope"), r6("q_BH").alias("q_BH"), "reject_BH", "direction_BH")


def _tst_sql() -> str:
    raw = long_sql(100).replace("series as (", "raw as (")
    return f"""with recursive {raw}{iterative_sql(_gate('threshold'), source='raw')} series as (select * from white),{cmk_sql()}{SEN} src as (select cell as id, p from cmk),{fdr_sql('src', 0.05)}
o as (select b.id as cell, b.p, bky, slope, Sm, VarSm, bky <= 0.05 as rj from bky b join cmk on cmk.cell = b.id join sen on sen.cell = b.id)
{CELLS}, {q6('Sm', 4)} as "Sm", {q6('VarSm', 3)} as "VarSm", {q6('o.p', 5)} as p, {q6('slope', 4)} as slope, {q6('bky', 5)} as "q_BKY", rj as "reject_BKY", case when rj is null then null when rj and slope > 0 then 1 when rj and slope < 0 then -1 else 0 end as "direction_BKY" {AT} o using (cell)"""


@query(_tst_sql())
def workflow_true_trends(spark, sf):
    out = workflow_tst(lineitem_stack(spark, sf)).cells
    digits = {"Sm": 4, "VarSm": 3, "p": 5, "slope": 4, "q_BKY": 5}
    return out.select("cell", "row", "col", "ok", *(r6(c, n).alias(c) for c, n in digits.items()), "reject_BKY", "direction_BKY")


@query(f"""with {long_sql(400, 'year')}{MK}{FIT} src as (select cell as id, p from mk),{fdr_sql('src', 0.2)}
o as (select b.id as cell, b.p, by_, slope, S, VarS, by_ <= 0.2 as rj from bky b join mk on mk.cell = b.id join ols on ols.cell = b.id)
{CELLS}, S as "S", {q6('VarS')} as "VarS", {q6('o.p')} as p, {q6('slope')} as slope, {q6('by_')} as "q_BY", rj as "reject_BY" {AT} o using (cell)""")
def workflow_configurable(spark, sf):
    out = workflow_trends(lineitem_stack(spark, sf, 400, "year"), "none", "MK", "OLS", "BY", q=0.2).cells
    return rounded(out.select("cell", "row", "col", "ok", "S", "VarS", "p", "slope", "q_BY", "reject_BY"))


def _inspected_sql() -> str:
    z, t = normal_quantile(0.975), t_quantile(0.975, 26)
    end = lambda side: f"greatest(round_even((k - {z!r} * sqrt(VarS)) / 2, 0), 1)::int" if side < 0 else f"least(round_even((k + {z!r} * sqrt(VarS)) / 2, 0) + 1, k)::int"
    return f"""with {long_sql(100)}{VCTFPW}
src as (
  select 1 as cell, t, value from series where cell = 45
  union all select 2, t, case when ch then r * k + beta * (t - 1) else value end from wh join nb using (cell) where cell = 45)
select 45::bigint as cell, case cell when 1 then 'raw' else 'prewhitened' end as series, method, {q6('slope')} as slope, {q6('intercept')} as intercept, {q6('lower')} as lower, {q6('upper')} as upper from (
  with series as (select * from src), {SEN}
  ti as (select s.cell, quantile_cont(value - slope * t, 0.5) as intercept from series s join sen using (cell) group by s.cell),
  {TIES}{VARIANCE}
  o as (select cell, list_sort(list(s)) as l, count(*)::double as k from slopes group by cell),
  b as (select cell, l[{end(-1)}] as lower, l[{end(1)}] as upper from o join variance using (cell)),
  {FIT}
  f as (select o.cell, slope, yb - slope * tb as intercept, sqrt(rss / (n - 2) / sxx) as se from ols o join rss using (cell), dims),
  both_ as (select a.cell, a.t, (b.value - a.value) / (b.t - a.t) as s, a.value - (b.value - a.value) / (b.t - a.t) * a.t as i from series a join series b on a.cell = b.cell and a.t <> b.t),
  inn as (select cell, t, list_sort(list(s))[count(*) // 2 + 1] as s, list_sort(list(i))[count(*) // 2 + 1] as i from both_ group by cell, t),
  rm as (select cell, list_sort(list(s))[count(*) // 2 + 1] as slope, list_sort(list(i))[count(*) // 2 + 1] as intercept from inn group by cell)
  select cell, 'TS' as method, slope, intercept, lower, upper from sen join ti using (cell) join b using (cell)
  union all select cell, 'OLS', slope, intercept, slope - {t!r} * se, slope + {t!r} * se from f
  union all select cell, 'RM', slope, intercept, null, null from rm)"""


@query(_inspected_sql())
def inspected_cell(spark, sf):
    stack = lineitem_stack(spark, sf)
    white, _ = prewhiten.prewhiten(stack, "VCTFPW")
    return rounded(inspect.inspect_cell(stack, 45, white))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: robust trends of a 20 x 20 grid of yearly prices."""
    return workflow_rta(lineitem_stack(spark, sf_dir, 400, "year")).cells

"""Grids of time series as DataFrames.

Long form: grid_id, cell, t (1 to n), value. Array form: grid_id, cell, row, col, y (one element per layer,
null where missing) and ok (no layer is missing). Cells are numbered row by row from 1; row 1 is on top.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.validate import time_axis

KEYS = ("grid_id", "cell")
CHUNK = 65_536


@dataclass(frozen=True)
class GridSpec:
    """The shape of a grid and its time axis."""

    nrow: int
    ncol: int
    n_time: int
    times: tuple[float, ...] = field(default=())

    def __post_init__(self):
        if min(self.nrow, self.ncol, self.n_time) < 1:
            raise ValueError("a grid needs rows, columns and layers")
        object.__setattr__(self, "times", tuple(time_axis(self.times or range(1, self.n_time + 1), self.n_time)))

    @property
    def n_cells(self) -> int:
        return self.nrow * self.ncol

    def row(self, cell: Column) -> Column:
        return (F.floor((cell - 1) / self.ncol) + 1).cast("int")

    def col(self, cell: Column) -> Column:
        return ((cell - 1) % self.ncol + 1).cast("int")

    def t(self) -> Column:
        return F.array(*(F.lit(float(x)) for x in self.times))

    def with_layers(self, n: int, times: tuple[float, ...] = ()) -> GridSpec:
        return GridSpec(self.nrow, self.ncol, n, times)


@dataclass(frozen=True)
class Stack:
    """A grid of series: the array form and its spec."""

    cells: DataFrame
    spec: GridSpec

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession


def clean(value: Column) -> Column:
    """NaN counts as missing; infinite values are kept for the callers to refuse."""
    return F.when(F.isnan(value), None).otherwise(value)


def to_stack(long: DataFrame, spec: GridSpec) -> Stack:
    """Array form of a long grid: one shuffle by cell. Cells without rows are present with ok = false."""
    rows = long.select("grid_id", F.col("cell").cast("long").alias("cell"), F.col("t").cast("int").alias("t"), clean(F.col("value").cast("double")).alias("value"))
    rows = rows.where(F.col("t").between(1, spec.n_time) & F.col("cell").between(1, spec.n_cells) & F.col("value").isNotNull())
    grids = long.select("grid_id").distinct()
    # cells of a grid in chunks, so that no row holds more than CHUNK numbers and one grid fills many tasks
    chunks = grids.select("grid_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((spec.n_cells - 1) // CHUNK).cast("long"))).alias("chunk"))
    if spec.n_cells > CHUNK:
        chunks = chunks.repartition("grid_id", "chunk")
    first = F.col("chunk") * CHUNK + 1
    skeleton = chunks.select("grid_id", F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.lit(spec.n_cells).cast("long")))).alias("cell"))
    series = rows.groupBy("grid_id", "cell").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s"))
    by_t = F.map_from_arrays(F.col("s.t"), F.col("s.value"))
    whole = F.size("s") == spec.n_time
    y = F.when(whole, F.col("s.value")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(spec.n_time)), lambda k: F.element_at(F.coalesce(by_t, F.create_map().cast("map<int,double>")), k)))
    cells = skeleton.join(series, ["grid_id", "cell"], "left").select("grid_id", "cell", spec.row(F.col("cell")).alias("row"), spec.col(F.col("cell")).alias("col"), y.alias("y"))
    return Stack(cells.withColumn("ok", F.coalesce(complete(F.col("y")), F.lit(False))), spec)


def complete(y: Column) -> Column:
    return ~F.exists(y, lambda x: x.isNull() | F.isnan(x))


def to_long(stack: Stack, y: str = "y") -> DataFrame:
    rows = stack.cells.select("grid_id", "cell", F.posexplode(y).alias("k", "value"))
    return rows.select("grid_id", "cell", (F.col("k") + 1).alias("t"), "value")


def with_series(stack: Stack, cells: DataFrame, n: int | None = None, times: tuple[float, ...] = ()) -> Stack:
    spec = stack.spec if n is None else stack.spec.with_layers(n, times)
    return Stack(cells.withColumn("ok", F.coalesce(complete(F.col("y")), F.lit(False))), spec)


def require_valid(stack: Stack) -> None:
    if stack.cells.where("ok").limit(1).count() == 0:
        raise ValueError("no cell has a complete series")


def when_ok(value: Column) -> Column:
    """A value for complete series, else null; incomplete cells stay in every result."""
    return F.when(F.col("ok"), value)

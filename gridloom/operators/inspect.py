"""Closer looks at single cells: their series, fits, neighbours, and the effect of prewhitening."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import GridSpec, Stack, to_long
from gridloom.operators.slope import fit_all
from gridloom.operators.spatial import neighbourhood


def neighbours_of(stack: Stack, cell: int, connectivity: str = "queen", window_size: int = 3) -> list[int]:
    """The cell and its neighbours inside the grid."""
    spec = stack.spec
    row, col = divmod(cell - 1, spec.ncol)
    if not 0 <= row < spec.nrow:
        raise ValueError(f"no cell {cell}")
    offsets = neighbourhood(spec, connectivity, window_size).offsets
    around = [(row + r, col + c) for r, c in ((0, 0), *offsets)]
    return sorted(r * spec.ncol + c + 1 for r, c in around if 0 <= r < spec.nrow and 0 <= c < spec.ncol)


def aggregate_series(stack: Stack, cells: list[int]) -> DataFrame:
    """grid_id, t, value: the median of the cells' present values in each layer."""
    chosen = Stack(stack.cells.where(F.col("cell").isin(cells)), stack.spec)
    return to_long(chosen).groupBy("grid_id", "t").agg(F.median("value").alias("value"))


@dataclass(frozen=True)
class Extent:
    """Where a grid lies: row 1 at ymax, column 1 at xmin."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float


def polygon_edges(spec: GridSpec, rings: DataFrame, extent: Extent | None = None) -> DataFrame:
    """polygon, x1, y1, x2, y2: the edges of the rings in grid units, x to the right and y down from the top left corner.

    rings has polygon and ring, an array of (x, y) in the extent's units (grid units where none is given); rings of one polygon are
    combined by the even-odd rule, so a ring inside another is a hole. A ring closes itself.
    """
    e = extent or Extent(0.0, float(spec.ncol), 0.0, float(spec.nrow))
    n = F.size("ring")
    corners = rings.where(n > 1).select("polygon", "ring", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    a, b = F.element_at("ring", F.col("i")), F.element_at("ring", F.col("i") % F.size("ring") + 1)
    x = lambda p: (p["x"] - e.xmin) / ((e.xmax - e.xmin) / spec.ncol)
    y = lambda p: ((e.ymax - p["y"]) if extent else p["y"]) / ((e.ymax - e.ymin) / spec.nrow)
    return corners.select("polygon", x(a).alias("x1"), y(a).alias("y1"), x(b).alias("x2"), y(b).alias("y2"))


def polygon_spans(spec: GridSpec, rings: DataFrame, extent: Extent | None = None) -> DataFrame:
    """polygon, row, first, last: the columns of each row whose cell centres a polygon covers, as runs.

    A scan line goes through the centres of each row: an edge meets the rows between its ends, half-open, and the sorted places where
    edges meet a row open and close its runs in turn. A polygon so small that it covers no centre has the cells that its edges touch.
    """
    edges = polygon_edges(spec, rings, extent)
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.ceil(top + 0.5), F.lit(1)), F.least(F.ceil(bottom + 0.5) - 1, F.lit(spec.nrow))
    met = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.col("x1") + (F.col("row") - 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = met.groupBy("polygon", "row").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    runs = lines.select("polygon", "row", "xs", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))).alias("i"))
    start, stop = F.ceil(F.element_at("xs", F.col("i")) + 0.5), F.ceil(F.element_at("xs", F.col("i") + 1) + 0.5) - 1
    covered = runs.select("polygon", "row", F.greatest(start, F.lit(1)).cast("int").alias("first"), F.least(stop, F.lit(spec.ncol)).cast("int").alias("last")).where("first <= last")
    small = edges.join(covered.select("polygon").distinct(), "polygon", "left_anti")
    band = F.sequence((F.floor(top) + 1).cast("int"), (F.floor(bottom) + 1).cast("int"))
    touched = small.withColumn("row", F.explode(band)).where(F.col("row").between(1, spec.nrow))
    low, high = F.greatest(F.col("row") - 1.0, top), F.least(F.col("row").cast("double"), bottom)
    side = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    level = F.col("y1") == F.col("y2")
    left, right = F.when(level, F.least("x1", "x2")).otherwise(F.least(side(low), side(high))), F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(side(low), side(high)))
    touched = touched.select("polygon", "row", F.greatest(F.floor(left) + 1, F.lit(1)).cast("int").alias("first"), F.least(F.floor(right) + 1, F.lit(spec.ncol)).cast("int").alias("last")).where("first <= last")
    return covered.unionByName(touched)


def polygon_series(stack: Stack, rings: DataFrame, extent: Extent | None = None) -> DataFrame:
    """grid_id, polygon, t, value: the median of the present values of each polygon's cells in each layer, all polygons in one pass.

    Cells meet the runs of their row; no list of a polygon's cells is made.
    """
    spans = polygon_spans(stack.spec, rings, extent).alias("s")
    cells = stack.cells.select("grid_id", "cell", "row", "col", "y").alias("c")
    inside = cells.join(spans, (F.col("c.row") == F.col("s.row")) & F.col("c.col").between(F.col("s.first"), F.col("s.last")))
    inside = inside.select("grid_id", "polygon", "cell", "y").dropDuplicates(["grid_id", "polygon", "cell"])
    long = inside.select("grid_id", "polygon", F.posexplode("y").alias("k", "value"))
    return long.groupBy("grid_id", "polygon", (F.col("k") + 1).alias("t")).agg(F.median("value").alias("value"))


def inspect_cell(stack: Stack, cell: int, prewhitened: Stack | None = None, aggregate: bool = False, connectivity: str = "queen", window_size: int = 3, level: float = 0.95) -> DataFrame:
    """Fits of all slope methods for a cell (or the median of its neighbourhood), raw and, where given, prewhitened."""
    def of(source: Stack, name: str) -> DataFrame:
        if aggregate:
            rows = aggregate_series(source, neighbours_of(source, cell, connectivity, window_size))
            rows = rows.groupBy("grid_id").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s")).where(F.size("s") == source.spec.n_time)
            one = rows.select("grid_id", F.lit(cell).cast("long").alias("cell"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("s.value").alias("y"), F.lit(True).alias("ok"))
        else:
            one = source.cells.where(F.col("cell") == cell)
        return fit_all(Stack(one, source.spec), level).withColumn("series", F.lit(name))

    out = of(stack, "raw")
    return out.unionByName(of(prewhitened, "prewhitened")) if prewhitened is not None else out


def small_multiples(stack: Stack, cell: int, connectivity: str = "queen", window_size: int = 3) -> DataFrame:
    """Fits of every method for the cell and each of its neighbours."""
    return fit_all(Stack(stack.cells.where(F.col("cell").isin(neighbours_of(stack, cell, connectivity, window_size))), stack.spec))


def panel(stack: Stack, cell: int, fits: DataFrame) -> DataFrame:
    """Plot-ready rows of a cell: t, value and each method's fitted value."""
    times = F.array(*(F.lit(float(x)) for x in stack.spec.times))
    rows = to_long(Stack(stack.cells.where(F.col("cell") == cell), stack.spec)).withColumn("time", F.element_at(times, F.col("t")))
    lines = fits.where(F.col("cell") == cell).select("grid_id", "method", "slope", "intercept")
    return rows.join(lines, "grid_id").select("grid_id", "cell", "method", "t", "time", "value", (F.col("intercept") + F.col("slope") * F.col("time")).alias("fitted"))

"""Neighbourhood operators on planar grids.

Cells are dealt by square tiles, those near a tile's edge to the tiles beyond it too, which is the only shuffle; inside a
tile windows are sums and medians in numpy whose cost hardly depends on their size (``operators.tiles``). A tile of
32 x 32 cells with a window of 3 is shuffled 1.13 times. No cell-by-cell matrix and no join of cells with cells is made.
The table of neighbours itself (``edges``) is there for inspection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice, odd_window
from gridloom.operators import tiles
from gridloom.operators.grid import GridSpec

CONNECTIVITY = ("queen", "rook")
TILE = 32
IN_TILE = ("__i", "__j")
FIELDS = 100_000


@dataclass(frozen=True)
class Neighbourhood:
    """Offsets (rows, columns) of the neighbours, without the cell itself, and what they were made for."""

    nrow: int
    ncol: int
    connectivity: str
    window_size: int
    offsets: tuple[tuple[int, int], ...]

    def check(self, spec: GridSpec, connectivity: str, window_size: int) -> None:
        if (self.nrow, self.ncol, self.connectivity, self.window_size) != (spec.nrow, spec.ncol, connectivity, window_size):
            raise ValueError("the neighbourhood was made for another grid, connectivity or window")


def neighbourhood(spec: GridSpec, connectivity: str = "queen", window_size: int = 3) -> Neighbourhood:
    """Queen: the full square; rook: the arms of a cross."""
    choice(connectivity, CONNECTIVITY, "connectivity")
    reach = odd_window(window_size) // 2
    steps = range(-reach, reach + 1)
    offsets = tuple((r, c) for r in steps for c in steps if (r, c) != (0, 0) and (connectivity == "queen" or r == 0 or c == 0))
    return Neighbourhood(spec.nrow, spec.ncol, connectivity, window_size, offsets)


def dealt_by_tile(rows: DataFrame, around: Neighbourhood, by: tuple[str, ...]) -> DataFrame:
    """rows once for each tile (__i, __j) in which a cell is or has a neighbour, all rows of a tile together."""
    reach = max(max(abs(r), abs(c)) for r, c in around.offsets)

    def tiles(at: Column, n: int) -> Column:
        first, last = F.floor((F.greatest(at - reach, F.lit(1)) - 1) / TILE), F.floor((F.least(at + reach, F.lit(n)) - 1) / TILE)
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    out = rows.withColumn("__i", tiles(F.col("row"), around.nrow)).withColumn("__j", tiles(F.col("col"), around.ncol))
    return out.repartition(*by, "__i", "__j")


def sent(rows: DataFrame, around: Neighbourhood, include_self: bool, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """rows once for each cell they are a neighbour of, in ``target``; needs row and col.

    Rows of one target are in one partition, and grouping by (*by, *IN_TILE) needs no further shuffle.
    """
    offsets = around.offsets + (((0, 0),) if include_self else ())
    table = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets))
    out = dealt_by_tile(rows, around, by)
    out = out.withColumn("__o", F.explode(table)).withColumn("__r", F.col("row") + F.col("__o.r")).withColumn("__c", F.col("col") + F.col("__o.c"))
    out = out.where(F.col("__r").between(F.col("__i") * TILE + 1, F.least((F.col("__i") + 1) * TILE, F.lit(around.nrow))))
    out = out.where(F.col("__c").between(F.col("__j") * TILE + 1, F.least((F.col("__j") + 1) * TILE, F.lit(around.ncol))))
    return out.withColumn("target", ((F.col("__r") - 1) * around.ncol + F.col("__c")).cast("long")).drop("__o", "__r", "__c")


def edges(cells: DataFrame, around: Neighbourhood) -> DataFrame:
    """(grid_id, cell, nbr): both ends among the valid cells. For inspection; the operators do without it."""
    valid = cells.where("ok")
    out = sent(valid.select("grid_id", F.col("cell").alias("nbr"), "row", "col"), around, False).select("grid_id", F.col("target").alias("cell"), "nbr")
    return out.join(valid.select("grid_id", "cell"), ["grid_id", "cell"], "left_semi")


def reach_of(connectivity: str, window_size: int) -> int:
    choice(connectivity, CONNECTIVITY, "connectivity")
    return odd_window(window_size) // 2


def focal_median(cells: DataFrame, value: str, spec: GridSpec, window_size: int = 3) -> DataFrame:
    """cells with ``value`` replaced by the median of the present values in its window; missing cells stay missing."""
    have = cells.where(F.col(value).isNotNull()).select("grid_id", "row", "col", F.col(value).cast("double").alias("__x"))

    def kernel(keys, block, reach):
        return {"present": tiles.inner(block["present"], reach), "__m": tiles.window_medians(block["__x"], reach)}

    medians = tiles.by_tile(have, (spec.nrow, spec.ncol), reach_of("queen", window_size), ("grid_id",), kernel, "__m double").drop("row", "col")
    return cells.join(medians, ["grid_id", "cell"], "left").withColumn(value, F.col("__m")).drop("__m")


def focal_mean(layers: DataFrame, value: str, spec: GridSpec, window_size: int) -> DataFrame:
    """Long layers (grid_id, cell, row, col, t, value) with each value replaced by the mean of its window's present values."""
    have = layers.where(F.col(value).isNotNull()).select("grid_id", "t", "row", "col", F.col(value).cast("double").alias("__x"))

    def kernel(keys, block, reach):
        n = tiles.window_sums(block["present"], reach, include_self=True)
        return {"present": n > 0, "__m": tiles.window_sums(block["__x"], reach, include_self=True) / np.maximum(n, 1)}

    means = tiles.by_tile(have, (spec.nrow, spec.ncol), reach_of("queen", window_size), ("grid_id", "t"), kernel, "__m double").drop("row", "col")
    return layers.join(means, ["grid_id", "t", "cell"], "left").withColumn(value, F.col("__m")).drop("__m")


# ------------------------------------------------------------------ spatial autocorrelation


def one_row_side(fields: DataFrame) -> DataFrame:
    """A side with one row per field: computed once, and broadcast where its checked count allows it, so that no
    task gets all cells of a field."""
    fields = checkpointed(fields)
    return F.broadcast(fields) if fields.limit(FIELDS + 1).count() <= FIELDS else fields


def moran_class(i: Column) -> Column:
    """low below 0.1, moderate below 0.3, else strong, by absolute value."""
    return F.when(F.abs(i) < 0.1, "low").when(F.abs(i) < 0.3, "moderate").when(i.isNotNull(), "strong")


def check_field(cells: DataFrame, value: str, method: str) -> None:
    """Refuse fields on which the statistic is undefined: one aggregate over the field."""
    x = F.col(value)
    r = cells.groupBy("grid_id").agg(
        F.count(x).alias("n"), F.max((F.abs(x) == float("inf")).cast("int")).alias("inf"), F.min(x).alias("lo"), F.max(x).alias("hi")).agg(
        F.min("n").alias("n"), F.max("inf").alias("inf"), F.min("lo").alias("lo"), F.min(F.col("hi") - F.col("lo")).alias("span"), F.min(F.greatest(F.abs("lo"), F.abs("hi"))).alias("top")).first()
    if r["n"] is None or r["n"] < 3:
        raise ValueError("spatial autocorrelation needs three valid cells or more")
    if r["inf"]:
        raise ValueError("values must be finite or missing")
    if method == "moran" and not r["span"] > 0:
        raise ValueError("Moran's I needs values that vary")
    if method == "getis_ord" and (r["lo"] < 0 or not r["top"] > 0):
        raise ValueError("Getis-Ord needs values of 0 or more that are not all 0")


def lagged(cells: DataFrame, spec: GridSpec, connectivity: str = "queen", window_size: int = 3, value: str = "z", by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """by, cell, z, wz and k of valid cells: the value, the sum of the neighbours' values, and their number (0 and 0 without)."""
    rows = cells.select(*by, "row", "col", F.col(value).cast("double").alias("z"))

    def kernel(keys, block, reach):
        return {
            "present": tiles.inner(block["present"], reach), "z": tiles.inner(block["z"], reach),
            "wz": tiles.window_sums(block["z"], reach, connectivity), "k": tiles.window_sums(block["present"], reach, connectivity),
        }

    return tiles.by_tile(rows, (spec.nrow, spec.ncol), reach_of(connectivity, window_size), by, kernel, "z double, wz double, k long").drop("row", "col")


def valid_field(cells: DataFrame, value: str, centre: bool, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """Valid cells with z: the value, or its deviation from the field's mean."""
    rows = cells.where(F.col(value).isNotNull()).select(*by, "cell", "row", "col", F.col(value).alias("z"))
    if not centre:
        return rows
    means = rows.groupBy(*by).agg(F.avg("z").alias("__mean"))
    return rows.join(one_row_side(means), list(by)).withColumn("z", F.col("z") - F.col("__mean")).drop("__mean")


def global_statistic(cells: DataFrame, spec: GridSpec, value: str = "x", method: str = "moran", connectivity: str = "queen", window_size: int = 3, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """One row per field: statistic, n (valid cells), s0 (neighbour links). Moran's I, or General G on raw values."""
    choice(method, ("moran", "getis_ord"), "method")

    def kernel(keys, block, reach):
        own, z = tiles.inner(block["present"], reach), tiles.inner(block["z"], reach)
        wz, k, z = tiles.window_sums(block["z"], reach, connectivity)[own], tiles.window_sums(block["present"], reach, connectivity)[own], z[own]
        return {"n": np.array([len(z)]), "s0": np.array([k.sum()]), "zwz": np.array([(z * wz).sum()]), "zz": np.array([(z * z).sum()]), "sz": np.array([z.sum()])}

    rows = valid_field(cells, value, method == "moran", by).select(*by, "row", "col", F.col("z").cast("double").alias("z"))
    shares = tiles.by_tile(rows, (spec.nrow, spec.ncol), reach_of(connectivity, window_size), by, kernel, "n long, s0 long, zwz double, zz double, sz double", per_tile=True)
    sums = shares.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "s0", "zwz", "zz", "sz")))
    if method == "moran":
        stat = F.col("n") / F.nullif(F.col("s0"), F.lit(0)) * F.col("zwz") / F.col("zz")
    else:
        stat = F.col("zwz") / (F.col("sz") * F.col("sz") - F.col("zz"))
    return sums.select(*by, stat.alias("statistic"), "n", "s0")


def local_statistic(cells: DataFrame, spec: GridSpec, value: str = "x", method: str = "moran", connectivity: str = "queen", window_size: int = 3, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """by, cell and the local statistic of each valid cell (null without neighbours): local I, or Gi* with the cell itself."""
    choice(method, ("moran", "getis_ord"), "method")
    rows = checkpointed(lagged(valid_field(cells, value, method == "moran", by), spec, connectivity, window_size, by=by))
    sums = rows.groupBy(*by).agg((F.sum(F.col("z") * F.col("z")) / F.count("*")).alias("m2"), F.sum("z").alias("sz"))
    rows = rows.join(one_row_side(sums), list(by))
    stat = F.col("z") * F.col("wz") / F.col("m2") if method == "moran" else (F.col("wz") + F.col("z")) / F.col("sz")
    return rows.select(*by, "cell", F.when(F.col("k") > 0, stat).alias("statistic"))

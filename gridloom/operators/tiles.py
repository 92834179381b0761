"""Work on square tiles of a grid in numpy: cells are dealt once by tile, with the rim that windows reach over.

A tile's side grows with the window's reach (at least ``TILE``, four times the reach), so cells are copied at most 2.25
times whatever the window. Inside a tile, sums over windows come from running sums along both axes, so their cost does not
depend on the window's size; medians slide along a row with a sorted window.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 32
SHORT = 2  # a reach up to which window sums are plain additions

Block = dict[str, np.ndarray]


def tile_side(reach: int) -> int:
    return max(TILE, 4 * reach)


def dealt(rows: DataFrame, shape: tuple[int, int], reach: int) -> DataFrame:
    """rows once for each tile (__i, __j) whose cells reach them; needs row and col."""
    side = tile_side(reach)

    def tiles(at: Column, n: int) -> Column:
        first, last = F.floor((F.greatest(at - reach, F.lit(1)) - 1) / side), F.floor((F.least(at + reach, F.lit(n)) - 1) / side)
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    return rows.withColumn("__i", tiles(F.col("row"), shape[0])).withColumn("__j", tiles(F.col("col"), shape[1]))


def by_tile(rows: DataFrame, shape: tuple[int, int], reach: int, by: Sequence[str], kernel: Callable[[tuple, Block, int], Block], schema: str, per_tile: bool = False) -> DataFrame:
    """kernel(keys, block, reach) of every tile of the fields ``by``; rows hold by, row, col and columns of numbers or of equally long arrays.

    The block has ``present`` and each other column as an array over the tile and its rim (missing: NaN, or 0 for integers).
    The kernel gives arrays over the tile without its rim; every place of the grid in the tile that ``present`` there marks becomes a
    row (by, cell, row, col, ...), as the schema of the further columns says. With per_tile its arrays are the rows (by, ...).
    """
    nrow, ncol = shape
    side, by = tile_side(reach), list(by)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    columns = [c for c in rows.columns if c not in (*by, "row", "col")]
    front = ", ".join(f"{c} {kinds[c]}" for c in by) + ("" if per_tile else ", cell long, row int, col int")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("__i")[0].as_py(), table.column("__j")[0].as_py()
        keys = tuple(table.column(c)[0].as_py() for c in by)
        top, left = i * side, j * side
        high, wide = min(side, nrow - top), min(side, ncol - left)
        at = (table.column("row").to_numpy() - 1 - top + reach, table.column("col").to_numpy() - 1 - left + reach)
        block: Block = {"present": np.zeros((high + 2 * reach, wide + 2 * reach), bool)}
        block["present"][at] = True
        for c in columns:
            values = table.column(c).combine_chunks()
            if pa.types.is_list(values.type):
                x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            else:
                x = values.to_numpy(zero_copy_only=False)
            if x.dtype.kind not in "iu":
                x = x.astype(np.float64)
            block[c] = np.full(block["present"].shape + x.shape[1:], 0 if x.dtype.kind in "iu" else np.nan, x.dtype)
            block[c][at] = x
        made = kernel(keys, block, reach)
        names = [c for c in made if c != "present"]
        if per_tile:
            n = len(made[names[0]])
            return pa.table([pa.repeat(table.column(k)[0], n) for k in by] + [_column(made[c]) for c in names], names=[*by, *names])
        r, c = np.nonzero(made["present"])
        cell = (r + top) * ncol + c + left + 1
        out = [pa.repeat(table.column(k)[0], len(r)) for k in by] + [pa.array(cell.astype(np.int64)), pa.array((r + top + 1).astype(np.int32)), pa.array((c + left + 1).astype(np.int32))]
        return pa.table(out + [_column(made[n][r, c]) for n in names], names=[*by, "cell", "row", "col", *names])

    return dealt(rows, shape, reach).groupBy(*by, "__i", "__j").applyInArrow(run, f"{front}, {schema}")


def _column(x: np.ndarray) -> pa.Array:
    """Numbers (NaN is null), or rows of numbers as lists."""
    if x.ndim == 1:
        return pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def inner(x: np.ndarray, reach: int) -> np.ndarray:
    """The tile without its rim."""
    return x[reach : x.shape[0] - reach, reach : x.shape[1] - reach]


def running(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Sums of 2 * reach + 1 neighbours along an axis."""
    x, n = np.moveaxis(x, axis, 0), x.shape[axis] - 2 * reach
    if reach <= SHORT:
        out = x[:n].copy()
        for k in range(1, 2 * reach + 1):
            out += x[k : k + n]
    else:
        sums = np.concatenate([np.zeros((1, *x.shape[1:]), x.dtype), x.cumsum(0)])
        out = sums[2 * reach + 1 :] - sums[:n]
    return np.moveaxis(out, 0, axis)


def window_sums(x: np.ndarray, reach: int, connectivity: str = "queen", include_self: bool = False) -> np.ndarray:
    """Sums over the neighbourhoods of the cells without the rim: squares (queen), or arms along rows and columns (rook)."""
    x = np.nan_to_num(x) if x.dtype.kind == "f" else x.astype(np.int64)
    own = inner(x, reach)
    if connectivity == "queen":
        whole = running(running(x, reach, 0), reach, 1)
    else:
        whole = running(x[:, reach : x.shape[1] - reach], reach, 0) + running(x[reach : x.shape[0] - reach], reach, 1) - own
    return whole if include_self else whole - own


def window_medians(x: np.ndarray, reach: int) -> np.ndarray:
    """Medians of the present (not NaN) values of square windows; NaN where there are none.

    Small windows are gathered at once. Wider ones slide along each row: a sorted list of the window's values gains a column and
    loses one, so a step costs the column's length times the logarithm of the window's.
    """
    width = 2 * reach + 1
    high, wide = x.shape[0] - 2 * reach, x.shape[1] - 2 * reach
    if width <= 5:
        near = np.lib.stride_tricks.sliding_window_view(x, (width, width)).reshape(high, wide, -1)
        ordered, n = np.sort(near, axis=2), (~np.isnan(near)).sum(2)
        low, up = np.maximum(n - 1, 0) // 2, n // 2
        pick = lambda k: np.take_along_axis(ordered, np.minimum(k, width * width - 1)[:, :, None], 2)[:, :, 0]
        return np.where(n > 0, (pick(low) + pick(up)) / 2, np.nan)
    out = np.full((high, wide), np.nan)
    for r in range(high):
        columns = [[v for v in x[r : r + width, c].tolist() if v == v] for c in range(x.shape[1])]
        held = sorted(v for column in columns[:width] for v in column)
        for c in range(wide):
            if c:
                for v in columns[c - 1]:
                    del held[bisect_left(held, v)]
                for v in columns[c + width - 1]:
                    insort(held, v)
            if held:
                out[r, c] = (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2
    return out

"""Permutation tests of spatial autocorrelation.

Permutations are stateless: the valid cells of a grid are numbered in their order by prefix counts of chunks, and in permutation k
cell number i has the value of cell number pi_k(i), a keyed Feistel permutation (``functions.feistel``). Nothing is sorted or joined
to draw a map. Cells are dealt once by tile; there all maps of a tile are arrays beside each other, with the observed map in
front, so one pass gives every null value of a cell, its moments and its counts, or a tile's share of every global sum.

A field of up to ``FIELD_CELLS`` valid cells is broadcast for the draws, after its count was checked. Beyond that each cell sends its
value to its places, which are grouped by number: the null rows are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.feistel import permute
from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice, positive_integer, probability
from gridloom.operators import tiles
from gridloom.operators.grid import CHUNK, GridSpec
from gridloom.operators.spatial import check_field, moran_class, neighbourhood, one_row_side

ALTERNATIVES = ("greater", "less", "two.sided")
FIELD_CELLS = 2_000_000


def numbered(cells: DataFrame, value: str) -> DataFrame:
    """grid_id, cell, row, col, x, number: the valid cells of each grid, numbered from 0 by cell.

    Chunks of ``CHUNK`` cells are counted, the counts are summed along each grid (one row a chunk), and a cell adds its place in its chunk.
    """
    valid = cells.where(F.col(value).isNotNull()).select("grid_id", "cell", "row", "col", F.col(value).cast("double").alias("x"), F.floor((F.col("cell") - 1) / CHUNK).alias("chunk"))
    counts = valid.groupBy("grid_id", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grid_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = one_row_side(counts.select("grid_id", "chunk", F.coalesce(before, F.lit(0)).alias("before")))
    place = F.row_number().over(Window.partitionBy("grid_id", "chunk").orderBy("cell")) - 1
    return valid.withColumn("place", place).join(starts, ["grid_id", "chunk"]).select("grid_id", "cell", "row", "col", "x", (F.col("before") + F.col("place")).alias("number"))


def field_sums(valid: DataFrame, centre: bool) -> DataFrame:
    """One row per grid, the same for all permutations: n, mean (0 unless centred), zz and sz of the deviations."""
    rows = valid.groupBy("grid_id").agg(F.count("*").alias("n"), (F.avg("x") if centre else F.lit(0.0)).alias("mean"), F.sum("x").alias("sz"), F.sum(F.col("x") * F.col("x")).alias("raw"))
    if not centre:
        return rows.select("grid_id", "n", "mean", F.col("raw").alias("zz"), "sz")
    rows = valid.join(one_row_side(rows.select("grid_id", "n", "mean")), "grid_id")
    z = F.col("x") - F.col("mean")
    return rows.groupBy("grid_id").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.sum(z * z).alias("zz"), F.sum(z).alias("sz"))


def sent(valid: DataFrame, sums: DataFrame, nperm: int, seed: int) -> DataFrame:
    """grid_id, number, perm, x: the value that each place gets in each permutation, sent by the cell that has it."""
    kind = dict(valid.dtypes)["grid_id"]

    def run(batches):
        perms = np.arange(1, nperm + 1)
        for b in batches:
            step = max(1, 1_000_000 // nperm)
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                number, n, x = (part.column(c).to_numpy() for c in (1, 2, 3))
                place = np.empty((len(number), nperm), np.int64)
                for size in np.unique(n):
                    own = n == size
                    place[own] = permute(number[own][:, None], int(size), seed, perms[None, :], inverse=True)
                grids = part.column(0).take(pa.array(np.repeat(np.arange(len(number)), nperm)))
                yield pa.RecordBatch.from_arrays([grids, pa.array(place.ravel()), pa.array(np.tile(perms, len(number)).astype(np.int32)), pa.array(np.repeat(x, nperm))], names=["grid_id", "number", "perm", "x"])

    rows = valid.join(one_row_side(sums.select("grid_id", "n")), "grid_id").select("grid_id", "number", "n", "x")
    return rows.mapInArrow(run, f"grid_id {kind}, number long, perm int, x double")


def permuted(cells: DataFrame, value: str, nperm: int, seed: int) -> DataFrame:
    """grid_id, perm (1 to nperm), cell, row, col, x: the valid cells with permuted values, one row each."""
    valid = checkpointed(numbered(cells, value))
    rows = sent(valid, field_sums(valid, False), nperm, seed)
    return rows.join(valid.drop("x"), ["grid_id", "number"]).select("grid_id", "perm", "cell", "row", "col", "x")


def maps_by_tile(cells: DataFrame, spec: GridSpec, value: str, method: str, nperm: int, seed: int, connectivity: str, window_size: int, kernel, schema: str, per_tile: bool, broadcast_cells: int = FIELD_CELLS) -> DataFrame:
    """kernel(z, wz, k, sums, own) of every tile: all maps' values and their neighbours' sums (rows, columns, 1 + nperm; the
    observed map first), the numbers of neighbours, the grid's sums, and which cells are valid."""
    reach = window_size // 2
    neighbourhood(spec, connectivity, window_size)  # refuses bad arguments
    valid = checkpointed(numbered(cells, value))
    sums = field_sums(valid, method == "moran")
    perms = np.arange(1, nperm + 1)
    few = valid.limit(broadcast_cells + 1).count() <= broadcast_cells
    if few:
        drawn, listed = {}, valid.select("grid_id", "number", "x").toArrow()
        grids = listed.column("grid_id").combine_chunks().dictionary_encode()
        codes, numbers, xs = grids.indices.to_numpy(zero_copy_only=False), listed.column("number").to_numpy(), listed.column("x").to_numpy()
        codes = np.nan_to_num(codes.astype(float), nan=-1).astype(int)
        for code in np.unique(codes):
            own = codes == code
            drawn[grids.dictionary[code].as_py() if code >= 0 else None] = xs[own][np.argsort(numbers[own])]
        shared = cells.sparkSession.sparkContext.broadcast(drawn)
        rows = valid.select("grid_id", "row", "col", "x", "number")
    else:
        arrays = sent(valid, sums, nperm, seed).groupBy("grid_id", "number").agg(F.array_sort(F.collect_list(F.struct("perm", "x")))["x"].alias("maps"))
        shared = None
        rows = valid.join(arrays, ["grid_id", "number"]).select("grid_id", "row", "col", "x", "maps")
    rows = rows.join(one_row_side(sums), "grid_id")

    def run(keys, block, reach):
        own = block["present"]
        have = np.nonzero(own)
        n, mean, zz, sz = (block[c][have[0][0], have[1][0]] for c in ("n", "mean", "zz", "sz"))
        z = np.zeros((*own.shape, 1 + nperm))
        if shared is not None:
            field = shared.value[keys[0]]
            z[have] = np.concatenate([block["x"][have][:, None], field[permute(block["number"][have][:, None], int(n), seed, perms[None, :])]], 1) - mean
        else:
            z[have] = np.concatenate([block["x"][have][:, None], block["maps"][have]], 1) - mean
        k = tiles.window_sums(own, reach, connectivity)
        return kernel(tiles.inner(z, reach), tiles.window_sums(z, reach, connectivity), k, (float(n), zz, sz), tiles.inner(own, reach))

    return tiles.by_tile(rows, (spec.nrow, spec.ncol), reach, ("grid_id",), run, schema, per_tile)


def p_value(greater: Column, less: Column, nperm: int, alternative: str) -> Column:
    up, down = (greater + 1) / F.lit(float(nperm + 1)), (less + 1) / F.lit(float(nperm + 1))
    return {"greater": up, "less": down, "two.sided": F.least(F.lit(1.0), 2 * F.least(up, down))}[alternative]


def map_statistics(cells: DataFrame, spec: GridSpec, value: str, method: str, nperm: int, seed: int, connectivity: str = "queen", window_size: int = 3, broadcast_cells: int = FIELD_CELLS) -> DataFrame:
    """grid_id, perm, statistic, n, s0 of the observed map (perm 0) and of every permutation."""
    choice(method, ("moran", "getis_ord"), "method")

    def kernel(z, wz, k, sums, own):
        return {"zwz": (z * wz)[own].sum(0)[None, :], "links": np.array([int(k[own].sum())]), "n": np.array([sums[0]]), "zz": np.array([sums[1]]), "sz": np.array([sums[2]])}

    shares = maps_by_tile(cells, spec, value, method, nperm, seed, connectivity, window_size, kernel, "zwz array<double>, links long, n double, zz double, sz double", True, broadcast_cells)
    each = shares.select("grid_id", "links", "n", "zz", "sz", F.posexplode("zwz").alias("perm", "zwz"))
    whole = each.groupBy("grid_id", "perm").agg(F.sum("zwz").alias("zwz"), F.sum("links").alias("s0"), F.first("n").alias("n"), F.first("zz").alias("zz"), F.first("sz").alias("sz"))
    moran = F.col("n") / F.nullif(F.col("s0"), F.lit(0)) * F.col("zwz") / F.col("zz")
    statistic = moran if method == "moran" else F.col("zwz") / (F.col("sz") * F.col("sz") - F.col("zz"))
    return whole.select("grid_id", "perm", statistic.alias("statistic"), F.col("n").cast("long").alias("n"), "s0")


def null_statistics(cells: DataFrame, spec: GridSpec, value: str, method: str, nperm: int, seed: int, connectivity: str = "queen", window_size: int = 3) -> DataFrame:
    """grid_id, perm, null: the statistic of every permutation."""
    return map_statistics(cells, spec, value, method, nperm, seed, connectivity, window_size).where("perm > 0").select("grid_id", "perm", F.col("statistic").alias("null"))


def global_test(
    cells: DataFrame, spec: GridSpec, value: str = "x", method: str = "moran", nperm: int = 99, alternative: str = "greater", seed: int = 1,
    connectivity: str = "queen", window_size: int = 3, validate: bool = True, broadcast_cells: int = FIELD_CELLS,
) -> DataFrame:
    """Per grid: statistic, n, s0, the null's min, mean, sd and max, z, p, p_floor and (for Moran) a class of magnitude."""
    nperm, alternative = positive_integer(nperm, "nperm"), choice(alternative, ALTERNATIVES, "alternative")
    if validate:
        check_field(cells, value, method)
    maps = checkpointed(map_statistics(cells, spec, value, method, nperm, seed, connectivity, window_size, broadcast_cells))  # 1 + nperm rows a grid
    observed = maps.where("perm = 0").drop("perm")
    null = maps.where("perm > 0").select("grid_id", F.col("statistic").alias("null")).join(observed.select("grid_id", F.col("statistic").alias("obs")), "grid_id")
    slack = 1e-12 * F.abs("obs")  # sums taken in another order must not turn a tie into a difference
    sums = null.groupBy("grid_id").agg(
        F.sum((F.col("null") >= F.col("obs") - slack).cast("int")).alias("ge"), F.sum((F.col("null") <= F.col("obs") + slack).cast("int")).alias("le"),
        F.min("null").alias("null_min"), F.avg("null").alias("null_mean"), F.stddev_samp("null").alias("null_sd"), F.max("null").alias("null_max"))
    out = observed.join(sums, "grid_id").withColumn("p", p_value(F.col("ge"), F.col("le"), nperm, alternative))
    out = out.withColumn("z", (F.col("statistic") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0))).withColumn("p_floor", F.lit(1 / (nperm + 1)))
    kind = moran_class(F.col("statistic")) if method == "moran" else F.lit(None).cast("string")
    return out.withColumn("magnitude", kind).drop("ge", "le")


def local_test(
    cells: DataFrame, spec: GridSpec, value: str = "x", method: str = "moran", nperm: int = 99, alternative: str = "two.sided", alpha: float = 0.05, seed: int = 1,
    connectivity: str = "queen", window_size: int = 3, validate: bool = True, broadcast_cells: int = FIELD_CELLS,
) -> DataFrame:
    """Per valid cell: statistic, null mean and sd over whole-map permutations, z, p, significant (p <= alpha, uncorrected).

    The two-sided test counts permutations at least as far from the cell's null mean as the observed value.
    """
    nperm, alternative, alpha = positive_integer(nperm, "nperm"), choice(alternative, ALTERNATIVES, "alternative"), probability(alpha, "alpha")
    choice(method, ("moran", "getis_ord"), "method")
    if validate:
        check_field(cells, value, method)

    def kernel(z, wz, k, sums, own):
        n, zz, sz = sums
        maps = z * wz / (zz / n) if method == "moran" else (wz + z) / sz
        maps = np.where((k > 0)[:, :, None], maps, np.nan)
        observed, null = maps[:, :, 0], maps[:, :, 1:]
        mean = null.mean(2)
        sd = null.std(2, ddof=1) if nperm > 1 else np.full(mean.shape, np.nan)
        slack = 1e-12 * np.maximum(np.abs(observed)[:, :, None], np.abs(null))
        first = observed[:, :, None]
        hit = {
            "greater": lambda: null >= first - slack, "less": lambda: null <= first + slack,
            "two.sided": lambda: np.abs(null - mean[:, :, None]) >= np.abs(first - mean[:, :, None]) - slack,
        }[alternative]()
        return {"present": own, "statistic": observed, "null_mean": mean, "null_sd": sd, "hits": hit.sum(2)}

    schema = "statistic double, null_mean double, null_sd double, hits long"
    out = maps_by_tile(cells, spec, value, method, nperm, seed, connectivity, window_size, kernel, schema, False, broadcast_cells).drop("row", "col")
    out = out.withColumn("z", (F.col("statistic") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)))
    out = out.withColumn("p", F.when(F.col("statistic").isNotNull(), (F.col("hits") + 1) / F.lit(float(nperm + 1)))).drop("hits")
    return out.withColumn("significant", F.col("p") <= alpha)


def local_summary(rows: DataFrame, method: str, alternative: str = "two.sided", nperm: int = 99, alpha: float = 0.05) -> DataFrame:
    """Per grid, of ``local_test``'s rows: method, scope, alternative, N, N_tested, nperm, the statistic's min, median and max, the lowest p,
    alpha, and how many cells, and which share of those tested, have p <= alpha."""
    found = F.coalesce(F.col("significant"), F.lit(False)).cast("int")
    out = rows.groupBy("grid_id").agg(
        F.count("*").alias("N"), F.count("statistic").alias("N_tested"), F.min("statistic").alias("statistic_min"), F.median("statistic").alias("statistic_median"), F.max("statistic").alias("statistic_max"),
        F.min("p").alias("raw_p_min"), F.sum(found).cast("long").alias("n_significant_raw"))
    share = F.round(100 * F.col("n_significant_raw") / F.nullif(F.col("N_tested"), F.lit(0)), 2)
    return out.select(
        "grid_id", F.lit(method).alias("method"), F.lit("local").alias("scope"), F.lit(alternative).alias("alternative"), "N", "N_tested", F.lit(nperm).alias("nperm"), "statistic_min", "statistic_median", "statistic_max",
        "raw_p_min", F.lit(float(alpha)).alias("alpha"), "n_significant_raw", share.alias("pct_significant_raw"))


def null_histogram(null: DataFrame, bins: int = 20) -> DataFrame:
    """grid_id, bin (1 to bins), lower, upper, n over the range of the null statistics."""
    span = null.groupBy("grid_id").agg(F.min("null").alias("lo"), F.max("null").alias("hi"))
    rows = null.join(span, "grid_id").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("width") > 0, F.least(F.lit(bins), F.floor((F.col("null") - F.col("lo")) / F.col("width")) + 1)).otherwise(F.lit(1)).cast("int")
    return rows.groupBy("grid_id", at.alias("bin"), "lo", "width").agg(F.count("*").alias("n")).select(
        "grid_id", "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("lower"), (F.col("lo") + F.col("bin") * F.col("width")).alias("upper"), "n")


def moran_advice(cells: DataFrame, spec: GridSpec, p: str = "p", nperm: int = 99, seed: int = 1) -> DataFrame:
    """Per grid: Moran's I of the p-values, its permutation p, and a recommendation: BH where p-values cluster, else none."""
    rows = global_test(cells.select("grid_id", "cell", "row", "col", F.col(p).alias("x")), spec, "x", "moran", nperm, "greater", seed)
    clustered = (F.col("statistic") >= 0) & (F.col("p") < 0.05)
    return rows.select("grid_id", "statistic", "p", F.when(clustered, "BH").alias("recommendation"), F.when(clustered, "positive dependence").otherwise("inconclusive").alias("finding"))

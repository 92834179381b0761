"""Simulated stacks with known truth.

Every random number is a hash of (seed, grid, place, time, purpose), so a stack does not depend on how
it is partitioned and any part of it can be made again. Fields with spatial covariance are drawn layer
by layer in numpy (a fast Fourier transform has no expression in SQL); all else is Spark expressions.
"""

from __future__ import annotations

import math
from functools import lru_cache
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dist import bessel_k, t_quantile
from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice
from gridloom.operators.grid import GridSpec
from gridloom.operators.spatial import focal_mean

SHAPES = ("radial", "gradient", "block", "square", "rectangle", "ellipse", "custom")
EXACT = ("square", "rectangle", "ellipse", "custom")
MODELS = ("independent", "exponential", "gaussian", "matern")
BREAKS = ("none", "mean", "trend")
LEVEL, CONSTANT = 10.0, 5.0


@dataclass(frozen=True)
class Scenario:
    """Everything a simulated stack depends on."""

    nrow: int = 15
    ncol: int = 15
    n_time: int = 10
    trend_strength: float = 0.15
    trend_shape: str = "radial"
    trend_fraction: float = 0.9
    ar1: float = 0.3
    noise_sd: float = 1.0
    noise_dist: str = "gaussian"
    t_df: float = 4.0
    smooth_radius: int = 1
    spatial_rho: float = 1.0
    spatial_model: str | None = None
    spatial_range: float = 3.0
    spatial_smoothness: float = 1.0
    signal_size: tuple[float, ...] = (0.4,)
    signal_location: tuple[float, float] = (0.5, 0.5)
    signal_angle: float = 0.0
    signal_axis_ratio: float = 0.5
    custom_mask: tuple[int, ...] = ()
    constant_block: bool = True
    break_type: str = "none"
    break_time: int | None = None
    break_fraction: float = 0.3
    break_magnitude: float = 2.0
    seed: int = 1

    def __post_init__(self):
        choice(self.trend_shape, SHAPES, "trend_shape")
        choice(self.noise_dist, ("gaussian", "t"), "noise_dist")
        choice(self.break_type, BREAKS, "break_type")
        if self.spatial_model is not None:
            choice(self.spatial_model, MODELS, "spatial_model")
        if not -1 < self.ar1 < 1 or self.noise_sd < 0 or self.n_time < 2:
            raise ValueError("ar1 lies inside (-1, 1), noise_sd is not negative, and there are two layers or more")
        if self.noise_dist == "t" and self.t_df <= 2:
            raise ValueError("t noise needs more than two degrees of freedom to have a variance")
        if self.trend_shape == "custom" and len(self.custom_mask) != self.nrow * self.ncol:
            raise ValueError("custom_mask has one 0 or 1 per cell")

    @property
    def spec(self) -> GridSpec:
        return GridSpec(self.nrow, self.ncol, self.n_time)

    @property
    def turning(self) -> int:
        return self.break_time if self.break_time is not None else self.n_time // 2


@dataclass(frozen=True)
class Simulation:
    long: DataFrame
    truth: DataFrame
    scenario: Scenario = field(default_factory=Scenario)


# ------------------------------------------------------------------ stateless random numbers


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) from the md5 of the key's parts joined by dashes; the same in any engine."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    digest = F.md5(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def gaussian(*key) -> Column:
    """Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(*key, "a"))) * F.cos(F.lit(2 * math.pi) * uniform(*key, "b"))


# ------------------------------------------------------------------ truth


def cells_of(spark: SparkSession, s: Scenario, grids: int = 1) -> DataFrame:
    """grid_id (1 to grids as text), cell, row, col."""
    rows = spark.range(grids * s.nrow * s.ncol).select(
        (F.floor(F.col("id") / (s.nrow * s.ncol)) + 1).cast("string").alias("grid_id"), (F.col("id") % (s.nrow * s.ncol) + 1).alias("cell"))
    return rows.select("grid_id", "cell", s.spec.row(F.col("cell")).alias("row"), s.spec.col(F.col("cell")).alias("col"))


def signal_shape(s: Scenario) -> Column:
    """The slope of a cell before blocks are thinned: an expression of row and col."""
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    a = F.lit(float(s.trend_strength))
    mid_r, mid_c = (s.nrow + 1) / 2, (s.ncol + 1) / 2
    if s.trend_shape == "radial":
        far = math.hypot(mid_r - 1, mid_c - 1) or 1.0
        d = F.sqrt((r - mid_r) * (r - mid_r) + (c - mid_c) * (c - mid_c))
        return a * F.exp(-d / F.lit(far / 2))
    if s.trend_shape == "gradient":
        return a * (c - mid_c) / F.lit(max((s.ncol - 1) / 2, 0.5))
    if s.trend_shape == "custom":
        return F.when(F.element_at(F.array(*map(F.lit, s.custom_mask)), F.col("cell").cast("int")) == 1, a).otherwise(F.lit(0.0))
    centre_r, centre_c = 1 + s.signal_location[0] * (s.nrow - 1), 1 + s.signal_location[1] * (s.ncol - 1)
    high = s.signal_size[0] * s.nrow
    wide = (s.signal_size[1] if len(s.signal_size) > 1 else s.signal_size[0]) * s.ncol
    if s.trend_shape == "square":
        high = wide = min(high, wide)
    angle = math.radians(s.signal_angle) if s.trend_shape in ("rectangle", "ellipse") else 0.0
    if s.trend_shape == "ellipse" and len(s.signal_size) == 1:
        high = wide * s.signal_axis_ratio
    u = (c - centre_c) * math.cos(angle) + (r - centre_r) * math.sin(angle)
    v = -(c - centre_c) * math.sin(angle) + (r - centre_r) * math.cos(angle)
    if s.trend_shape == "ellipse":
        inside = u * u / (wide / 2) ** 2 + v * v / (high / 2) ** 2 <= 1
    else:
        inside = (F.abs(u) <= wide / 2) & (F.abs(v) <= high / 2)
    return F.when(inside, a).otherwise(F.lit(0.0))


def chosen_blocks(s: Scenario, fraction: float, purpose: str) -> list[int]:
    """The blocks kept, by hash: round(fraction * blocks) of them. Blocks are a few dozen squares whatever the grid."""
    from hashlib import md5

    side, across, n = block_layout(s)
    order = sorted(range(n), key=lambda b: md5(f"{s.seed}-{purpose}-{b}".encode()).hexdigest())
    return sorted(order[: round(fraction * n)])


def block_layout(s: Scenario) -> tuple[int, int, int]:
    """(side of a block in cells, blocks in a row, blocks)."""
    side = max(2, round(min(s.nrow, s.ncol) / 5))
    across = math.ceil(s.ncol / side)
    return side, across, across * math.ceil(s.nrow / side)


def block_of(s: Scenario) -> Column:
    side, across, _ = block_layout(s)
    return (F.floor((F.col("row") - 1) / side) * across + F.floor((F.col("col") - 1) / side)).cast("int")


def truth_of(cells: DataFrame, s: Scenario) -> DataFrame:
    """cells with true_slope, true_break, true_signal, true_direction, constant."""
    slope = signal_shape(s)
    block = block_of(s)
    if s.trend_shape not in EXACT:
        keep = chosen_blocks(s, s.trend_fraction, "signal")
        flip = flipped(s, keep)
        slope = F.when(block.isin(keep), slope).otherwise(F.lit(0.0))
        slope = F.when(block.isin(flip), -slope).otherwise(slope) if flip else slope
    broken = block.isin(chosen_blocks(s, s.break_fraction, "break")) if s.break_type != "none" else F.lit(False)
    constant = (F.col("row") <= 2) & (F.col("col") <= 2) if s.constant_block else F.lit(False)
    rows = cells.withColumn("constant", constant)
    rows = rows.withColumn("true_slope", F.when(F.col("constant"), F.lit(0.0)).otherwise(slope) + 0.0)
    rows = rows.withColumn("true_break", F.when(F.col("constant"), F.lit(False)).otherwise(broken))
    return rows.withColumn("true_signal", (F.col("true_slope") != 0).cast("int")).withColumn("true_direction", F.signum("true_slope").cast("int"))


def flipped(s: Scenario, keep: list[int]) -> list[int]:
    """A tenth of the kept blocks, rounded down, whose sign is turned."""
    from hashlib import md5

    order = sorted(keep, key=lambda b: md5(f"{s.seed}-flip-{b}".encode()).hexdigest())
    return sorted(order[: len(keep) // 10])


# ------------------------------------------------------------------ noise


def correlation(model: str, d: np.ndarray, rho: float, reach: float, smoothness: float) -> np.ndarray:
    """Correlation at distance d; rho is that of neighbouring cells for the exponential and Gaussian models."""
    if model == "independent":
        return (d == 0).astype(float)
    if model == "exponential":
        return rho**d
    if model == "gaussian":
        return rho ** (d * d)
    x = np.where(d > 0, d, 1.0) / reach
    with np.errstate(invalid="ignore"):
        out = 2 ** (1 - smoothness) / math.gamma(smoothness) * x**smoothness * bessel_k(smoothness, x)
    return np.where(d > 0, np.nan_to_num(out), 1.0)


def spectrum(nrow: int, ncol: int, corr, doublings: int = 6) -> np.ndarray | None:
    """Eigenvalues of a circulant embedding of the grid's covariance, doubled until none is negative; None if it stays so."""
    h, w = 1 << (2 * nrow - 1).bit_length(), 1 << (2 * ncol - 1).bit_length()
    for _ in range(doublings + 1):
        r, c = np.minimum(np.arange(h), h - np.arange(h)), np.minimum(np.arange(w), w - np.arange(w))
        values = np.fft.fft2(corr(np.hypot(r[:, None], c[None, :]))).real
        if values.min() > -1e-8 * values.max():
            return np.maximum(values, 0)
        if max(h, w) > 4_096:
            break
        h, w = 2 * h, 2 * w
    return None


def factor(nrow: int, ncol: int, corr, most: int = 2_500) -> np.ndarray:
    """A square root of the covariance of all cells, for grids of at most ``most`` cells."""
    if nrow * ncol > most:
        raise ValueError("no embedding of this covariance is positive, and the grid is too large for the exact method")
    r, c = np.divmod(np.arange(nrow * ncol), ncol)
    values, vectors = np.linalg.eigh(corr(np.hypot(r[:, None] - r, c[:, None] - c)))
    return vectors * np.sqrt(np.maximum(values, 0))


def gaussian_field(nrow: int, ncol: int, spectral, root, rng: np.random.Generator) -> np.ndarray:
    if spectral is None:
        return (root @ rng.normal(size=nrow * ncol)).reshape(nrow, ncol)
    h, w = spectral.shape
    z = rng.normal(size=(h, w)) + 1j * rng.normal(size=(h, w))
    return np.fft.fft2(np.sqrt(spectral / (h * w)) * z).real[:nrow, :ncol]


@lru_cache(maxsize=8)
def _t_table(df: float) -> tuple[np.ndarray, np.ndarray]:
    """Normal scores from 0 to 8.2 and log1p of the t quantiles of the same probability; smooth up to the far tail."""
    z = np.linspace(0, 8.2, 411)
    return z, np.log1p([-t_quantile(0.5 * math.erfc(x / math.sqrt(2)), df) for x in z])


def t_of_normal(x: np.ndarray, df: float) -> np.ndarray:
    """The t values of the same probability as the normal scores x (beyond 8.2: that of 8.2)."""
    z, table = _t_table(df)
    return np.sign(x) * np.expm1(np.interp(np.abs(x), z, table))


def _layers(s: Scenario):
    corr = lambda d: correlation(s.spatial_model, d, s.spatial_rho, s.spatial_range, s.spatial_smoothness)

    def run(batches):
        spectral = spectrum(s.nrow, s.ncol, corr)
        root = factor(s.nrow, s.ncol, corr) if spectral is None else None
        for b in batches:
            for grid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rng = np.random.default_rng([abs(int(s.seed)), int(grid), int(t)])
                x = gaussian_field(s.nrow, s.ncol, spectral, root, rng).ravel()
                if s.noise_dist == "t":
                    scale = math.sqrt((s.t_df - 2) / s.t_df)
                    x = t_of_normal(x, s.t_df) * scale
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([grid] * n), pa.array(np.full(n, t, np.int32)), pa.array(np.arange(1, n + 1)), pa.array(x)], names=["grid_id", "t", "cell", "e"])

    return run


def innovations(spark: SparkSession, s: Scenario, grids: int) -> DataFrame:
    """grid_id, cell, t, e: innovations of unit variance, independent over time."""
    if s.spatial_model not in (None, "independent"):
        layers = spark.range(grids * s.n_time).select((F.floor(F.col("id") / s.n_time) + 1).cast("string").alias("grid_id"), (F.col("id") % s.n_time + 1).cast("int").alias("t"))
        return layers.repartition(min(grids * s.n_time, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_layers(s), "grid_id string, t int, cell long, e double")
    rows = cells_of(spark, s, grids).select("grid_id", "cell", F.explode(F.sequence(F.lit(1), F.lit(s.n_time))).alias("t"))
    key = (s.seed, F.col("grid_id"), F.col("cell"), F.col("t"))
    e = gaussian(*key)
    if s.noise_dist == "t":  # a normal over the root of a mean of squares: exact for whole degrees of freedom
        k = max(3, round(s.t_df))
        squares = sum((gaussian(*key, f"df{i}") * gaussian(*key, f"df{i}") for i in range(k)), F.lit(0.0))
        e = e / F.sqrt(squares / k) * math.sqrt((k - 2) / k)
    return rows.withColumn("e", e)


def noise(spark: SparkSession, s: Scenario, grids: int) -> DataFrame:
    """grid_id, cell, t, noise: first-order autoregressive in time with deviation noise_sd."""
    phi, sd = s.ar1, s.noise_sd
    rows = innovations(spark, s, grids).groupBy("grid_id", "cell").agg(F.sort_array(F.collect_list(F.struct("t", "e"))).alias("s"))
    step = math.sqrt(1 - phi * phi) * sd
    path = F.aggregate(
        F.slice("s.e", F.lit(2), F.size("s")), F.array(F.get("s.e", F.lit(0)) * F.lit(float(sd))),
        lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) * F.lit(float(phi)) + F.lit(step) * e)))
    return rows.select("grid_id", "cell", F.posexplode(path).alias("k", "noise")).select("grid_id", "cell", (F.col("k") + 1).alias("t"), "noise")


def smoothed_noise(rows: DataFrame, s: Scenario) -> DataFrame:
    """The neighbourhood-mean form of spatial noise: each layer is smoothed, brought back to its own deviation,
    blended with the unsmoothed noise by spatial_rho, and brought back again. Windows beyond twice the grid are not applied."""
    width = 2 * s.smooth_radius + 1
    if s.spatial_model is not None or s.smooth_radius < 1 or s.spatial_rho == 0 or s.noise_sd == 0:
        return rows
    if width > 2 * min(s.nrow, s.ncol):
        import warnings

        warnings.warn("the smoothing window is more than twice the grid; noise is left unsmoothed", stacklevel=3)
        return rows
    rows = checkpointed(rows)  # read four times below
    layers = rows.withColumn("row", s.spec.row(F.col("cell"))).withColumn("col", s.spec.col(F.col("cell")))
    smooth = focal_mean(layers.withColumn("m", F.col("noise")), "m", s.spec, width)

    def rescaled(rows: DataFrame, name: str) -> DataFrame:
        sds = rows.groupBy("grid_id", "t").agg(F.stddev_samp("noise").alias("__a"), F.stddev_samp(name).alias("__b"))
        return rows.join(sds, ["grid_id", "t"]).withColumn(name, F.when(F.col("__b") > 0, F.col(name) * F.col("__a") / F.col("__b")).otherwise(F.col(name))).drop("__a", "__b")

    smooth = checkpointed(rescaled(smooth, "m")).withColumn("m", s.spatial_rho * F.col("m") + (1 - s.spatial_rho) * F.col("noise"))
    return rescaled(smooth, "m").select("grid_id", "cell", "t", F.col("m").alias("noise"))


def simulate(spark: SparkSession, s: Scenario | None = None, grids: int = 1, **options) -> Simulation:
    """A stack of ``grids`` independent realisations: slope * t + noise + 10, with breaks and a constant corner."""
    s = s or Scenario(**options)
    truth = truth_of(cells_of(spark, s, grids), s)
    rows = smoothed_noise(noise(spark, s, grids), s).join(truth, ["grid_id", "cell"])
    after = F.col("true_break") & (F.col("t") > s.turning)
    jump = {"none": F.lit(0.0), "mean": F.lit(float(s.break_magnitude)), "trend": F.lit(float(s.break_magnitude)) * (F.col("t") - s.turning)}[s.break_type]
    value = F.col("true_slope") * F.col("t") + F.col("noise") + LEVEL + F.when(after, jump).otherwise(F.lit(0.0))
    long = rows.select("grid_id", "cell", "t", F.when(F.col("constant"), F.lit(CONSTANT)).otherwise(value).alias("value"))
    return Simulation(long, truth.drop("constant"), s)


# ------------------------------------------------------------------ factorial designs


def simulation_design(spark: SparkSession, factors: dict[str, list], constants: dict | None = None, prefix: str = "S") -> DataFrame:
    """One row per combination of factor levels, the first factor changing fastest: scenario, then the factors and constants."""
    if not factors or any(not v for v in factors.values()):
        raise ValueError("a design needs factors with levels")
    if clash := set(factors) & set(constants or {}):
        raise ValueError(f"both factor and constant: {sorted(clash)}")
    n = math.prod(len(v) for v in factors.values())
    columns, step = [], 1
    for name, levels in factors.items():
        table = F.array(*(F.lit(x) for x in levels))
        columns.append(F.get(table, (F.floor(F.col("id") / step) % len(levels)).cast("int")).alias(name))
        step *= len(levels)
    width = max(2, len(str(n)))
    scenario = F.concat(F.lit(prefix), F.lpad((F.col("id") + 1).cast("string"), width, "0")).alias("scenario")
    return spark.range(n).select(scenario, *columns, *(F.lit(v).alias(k) for k, v in (constants or {}).items()))


def design_summary(design: DataFrame) -> DataFrame:
    """factor, levels: distinct values per column of a design."""
    names = [c for c in design.columns if c != "scenario"]
    counts = design.agg(*(F.countDistinct(c).alias(c) for c in names))
    cases = F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("levels")) for c in names))
    return counts.select(F.explode(cases).alias("x")).select("x.factor", "x.levels")


def scenarios_of(design: DataFrame) -> list[tuple[str, Scenario]]:
    """The design's rows as scenarios (a design is a handful of rows)."""
    known = {f.name for f in fields(Scenario)}
    return [(r["scenario"], Scenario(**{k: v for k, v in r.asDict().items() if k in known and v is not None})) for r in design.collect()]

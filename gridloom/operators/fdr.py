"""False-discovery-rate control.

A p-value's adjusted value depends on how many values are not above it and on a minimum over all larger
ones. Both are found without a global sort: distinct values are counted, placed in monotone buckets, and
ranked inside their bucket; a table of at most a few thousand buckets per grid carries the offsets and
the minima from bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.lineage import checkpointed
from gridloom.functions.validate import choice, probability
from gridloom.operators.spatial import one_row_side

METHODS = ("BH", "BY", "BKY")
IMPLEMENTATIONS = ("multtest", "original")


def bucket(p: Column) -> Column:
    """A whole number that never falls as p rises: even steps, and powers of two for very small values."""
    fine = F.lit(2.0**-12)
    return F.when(p >= fine, F.floor(p * 4096)).when(p > 0, F.ceil(F.log2(p)) - 1).otherwise(F.lit(-5000)).cast("long")


def check(rows: DataFrame) -> None:
    r = rows.agg(F.count("p").alias("n"), F.min("p").alias("lo"), F.max(F.when(~F.isnan("p"), F.col("p"))).alias("hi")).first()
    if not r["n"]:
        raise ValueError("no p-value is present")
    if r["lo"] < 0 or (r["hi"] is not None and r["hi"] > 1):
        raise ValueError("p-values must lie between 0 and 1")


def ranked(rows: DataFrame) -> DataFrame:
    """grid_id and each distinct p: n, last (values not above it), m (values of the grid), raw
    (the running minimum of m p / rank) and bh, raw cut at 1."""
    distinct = rows.where(F.col("p").isNotNull()).groupBy("grid_id", "p").agg(F.count("*").alias("n")).withColumn("b", bucket(F.col("p")))
    sizes = distinct.groupBy("grid_id", "b").agg(F.sum("n").alias("in_b"))
    by = Window.partitionBy("grid_id").orderBy("b")
    offsets = sizes.select(
        "grid_id", "b", F.coalesce(F.sum("in_b").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("in_b").over(Window.partitionBy("grid_id")).alias("m"))
    inside = Window.partitionBy("grid_id", "b").orderBy("p")
    placed = distinct.join(offsets, ["grid_id", "b"])
    placed = placed.withColumn("last", F.col("before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("x", F.col("m") * F.col("p") / F.col("last"))
    placed = placed.withColumn("low_in", F.min("x").over(Window.partitionBy("grid_id", "b").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    lows = placed.groupBy("grid_id", "b").agg(F.min("x").alias("low"))
    later = Window.partitionBy("grid_id").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select("grid_id", "b", F.min("low").over(later).alias("low_later"))
    out = placed.join(lows, ["grid_id", "b"])
    raw = F.least("low_in", "low_later")  # least passes over nulls
    return out.select("grid_id", "p", "n", "last", "m", raw.alias("raw"), F.least(F.lit(1.0), raw).alias("bh"))


def harmonic(m: Column) -> Column:
    """Sum of 1 / k for k to m: summed outright up to a thousand terms, then by its expansion (error below 1e-16)."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(m, F.lit(1000))), F.lit(0.0), lambda s, k: s + 1 / k)
    x = m.cast("double")
    many = F.log(x) + F.lit(0.57721566490153286) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= 1000, few).otherwise(many)


def decided(rows: DataFrame, q: float = 0.05, original: bool = False) -> DataFrame:
    """Each distinct p of a grid with n, last, m, r1, m0, pi0 and, for every procedure, q_ and reject_ columns.

    All procedures come from one ranking. The original two-stage procedure steps up on the p-values
    themselves at a raised level; it has no adjusted values and costs one more aggregate, so it is asked for.
    """
    q = probability(q, "q")
    base = checkpointed(ranked(rows))  # the ranking is read two or three times below
    first = q / (1 + q)
    counts = base.groupBy("grid_id").agg(F.coalesce(F.sum(F.when(F.col("bh") < first, F.col("n"))), F.lit(0)).alias("r1"))  # one row per grid
    out = base.join(one_row_side(counts), "grid_id").withColumn("m0", F.col("m") - F.col("r1")).withColumn("pi0", F.col("m0") / F.col("m"))
    out = out.withColumn("q_BH", F.col("bh")).withColumn("q_BY", F.least(F.lit(1.0), F.col("raw") * harmonic(F.col("m"))))  # BY multiplies before it cuts at 1
    if not original:
        out = out.withColumn("q_BKY", F.col("bh") * F.col("pi0")).withColumn("reject_BKY", F.col("q_BKY") <= q)
    else:
        level = F.lit(first) * F.col("m") / F.col("m0")
        below = F.col("p") <= F.col("last") / F.col("m") * level
        top = out.where("m0 > 0 and r1 > 0").groupBy("grid_id").agg(F.max(F.when(below, F.col("last"))).alias("k"))
        out = out.join(one_row_side(top), "grid_id", "left").withColumn("q_BKY", F.lit(None).cast("double"))
        out = out.withColumn("reject_BKY", F.when(F.col("r1") == 0, F.lit(False)).when(F.col("m0") == 0, F.lit(True)).otherwise(F.col("last") <= F.coalesce("k", F.lit(0))))
    return out.withColumn("reject_BH", F.col("q_BH") <= q).withColumn("reject_BY", F.col("q_BY") <= q)


def adjusted(rows: DataFrame, method: str = "BH", q: float = 0.05, implementation: str = "multtest") -> DataFrame:
    """grid_id, p and for each distinct p: q_value (null for the original BKY), reject, last, m, m0, pi0."""
    choice(method, METHODS, "method")
    choice(implementation, IMPLEMENTATIONS, "implementation")
    out = decided(rows, q, implementation == "original" and method == "BKY")
    return out.select("grid_id", "p", F.col(f"q_{method}").alias("q_value"), F.col(f"reject_{method}").alias("reject"), "last", "m", "m0", "pi0")


def apply(rows: DataFrame, method: str = "BH", q: float = 0.05, implementation: str = "multtest") -> DataFrame:
    """rows (with grid_id and p) with q_value and reject; null where p is missing."""
    values = adjusted(rows, method, q, implementation).select("grid_id", "p", "q_value", "reject")
    return rows.join(values, ["grid_id", "p"], "left")


def correct(rows: DataFrame, methods: tuple[str, ...] = ("BH", "BKY"), q: float = 0.05, implementation: str = "multtest") -> DataFrame:
    """rows with reject_raw and, per method, q_<method> and reject_<method>."""
    rows = checkpointed(rows.withColumn("p", F.when(F.isnan("p"), None).otherwise(F.col("p"))))  # what made the p-values runs once
    check(rows)
    for m in methods:
        choice(m, METHODS, "method")
    choice(implementation, IMPLEMENTATIONS, "implementation")
    values = decided(rows, q, implementation == "original")
    values = values.select("grid_id", "p", *(c for m in methods for c in (f"q_{m}", f"reject_{m}")))
    return rows.withColumn("reject_raw", F.col("p") <= q).join(values, ["grid_id", "p"], "left")


def thresholds(rows: DataFrame, q: float = 0.05) -> DataFrame:
    """Distinct p-values with their rank and the lines they are compared with: q i / m (BH) and q i / (m pi0) (BKY)."""
    out = adjusted(rows, "BKY", q)
    line = F.col("last") / F.col("m") * q
    return out.select("grid_id", "p", F.col("last").alias("rank"), line.alias("bh_line"), (line / F.nullif(F.col("pi0"), F.lit(0.0))).alias("bky_line"))


def cutoffs(rows: DataFrame, q: float = 0.05) -> DataFrame:
    """Per grid, the largest rank at which p lies on or under each line (0 if none does)."""
    t = thresholds(rows, q)
    at = lambda line: F.coalesce(F.max(F.when(F.col("p") <= F.col(line), F.col("rank"))), F.lit(0)).cast("long")
    return t.groupBy("grid_id").agg(at("bh_line").alias("bh_cutoff"), at("bky_line").alias("bky_cutoff"))

"""Reading stacks of layers in time order that is checked and never alphabetical.

Layers are TIFF files (each band is one), or Parquet or CSV tables of row, col, value; any number of files is one scan.
Cubes are NetCDF classic files, or long tables (``long_from_cubes``).
"""

from __future__ import annotations

import math
import re
import statistics
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.sources import netcdf, tiff
from gridloom.sources.calendar import calendar_dates

# Tried in this order; the first that gives every name a different number wins.
PATTERNS = ("year([0-9]+)", "_A([0-9]{4})", "(19[0-9]{2}|20[0-9]{2})", "([0-9]{4})", "([0-9]+)")


SEASONS = "layers are less than a year apart; remove the seasonal cycle before testing for trends"


@dataclass(frozen=True)
class Layers:
    """Values (grid_id, cell, row, col, t, value) and the layers (t, layer_name, source, time)."""

    values: DataFrame
    layers: DataFrame
    n: int


def last_match(name: str, pattern: str) -> float | None:
    """The number captured at the last place where the pattern can match; None if there is none, or it is no number.

    What stands before the match is taken greedily, so an unbounded run of digits gives its last digit only.
    """
    found = re.match(f".*{pattern}", name)
    try:
        x = float(found.group(1) if found else name)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def order_of(names: Sequence[str], order_regex: str | None = None, candidates: Sequence[str] = PATTERNS) -> tuple[list[int], list[float], str]:
    """(order, numbers, pattern): positions of the names in numeric order, by the first pattern that tells all apart."""
    if not names:
        raise ValueError("no files")
    for pattern in [order_regex] if order_regex else candidates:
        numbers = [last_match(n, pattern) for n in names]
        if None not in numbers and len(set(numbers)) == len(numbers):
            order = sorted(range(len(names)), key=lambda i: numbers[i])
            return order, [numbers[i] for i in order], pattern
    raise ValueError("no pattern gives every file name a different number")


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get _1, _2, ... in order; no made name repeats a given one."""
    seen: dict[str, int] = {}
    taken, out = set(names), []
    for name in names:
        if name not in seen:
            seen[name] = 0
            out.append(name)
            continue
        while True:
            seen[name] += 1
            made = f"{name}_{seen[name]}"
            if made not in taken:
                break
        taken.add(made)
        out.append(made)
    return out


def checked_times(times: Sequence, n: int) -> list:
    """One finite date, timestamp or number per layer, strictly increasing."""
    times = list(times)
    if len(times) != n:
        raise ValueError(f"{len(times)} times for {n} layers")
    if any(x is None or not isinstance(x, (date, datetime, int, float)) or isinstance(x, bool) or (isinstance(x, float) and not math.isfinite(x)) for x in times):
        raise ValueError("times are dates, timestamps or finite numbers")
    if any(b <= a for a, b in zip(times, times[1:])):
        raise ValueError("times must be strictly increasing")
    return times


def read_ordered_stack(
    spark: SparkSession, directory: str | None = None, files: Sequence[str] | None = None, pattern: str = r"\.(tiff?|parquet|csv)$", order_regex: str | None = None,
    time: Sequence | None = None, cycle_type: str | None = None, start: date | None = None, end: date | None = None, time_anchor: str = "centre",
    grid_id: str = "g", ncol: int | None = None, layers: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None,
) -> Layers:
    """Layers from a directory (ordered by the numbers in their names) or from listed files (in the order given).

    Exactly one of directory and files; time or cycle_type with start, only with files; end only with cycle_type. Files
    may hold several bands, which are layers in their order; times are then one a band, and a directory needs one band a
    file. The ranges (first, last) restrict what is read; numbers of layers and cells stay those of the whole.
    """
    if (directory is None) == (files is None):
        raise ValueError("give either a directory or files")
    if time is not None and cycle_type is not None:
        raise ValueError("give either time or cycle_type")
    if cycle_type is not None and (files is None or start is None):
        raise ValueError("cycle_type needs files and start")
    if cycle_type is None and (start is not None or end is not None):
        raise ValueError("start and end belong to cycle_type")
    if time is not None and files is None:
        raise ValueError("time needs files; a directory is ordered by names")
    if directory is not None:
        listed = [p for p in list_files(spark, directory) if re.search(pattern, p.rsplit("/", 1)[-1])]
        names = [p.rsplit("/", 1)[-1] for p in listed]
        order, times, _ = order_of(names, order_regex)
        paths = [listed[i] for i in order]
    else:
        paths = list(files)
        if not paths or len(set(paths)) != len(paths):
            raise ValueError("files must be given, each once")
        if missing := [p for p in paths if not exists(spark, p)]:
            raise ValueError(f"no such file: {missing[0]}")
    kinds = {p.rsplit(".", 1)[-1].lower() for p in paths}
    if len(kinds) > 1 and kinds - {"tif", "tiff"}:
        raise ValueError(f"files of several kinds: {', '.join(sorted(kinds))}")
    if kinds <= {"tif", "tiff"}:
        values, bands, (_, width) = tiff.read_layers(spark, paths, layers, rows, cols)
        ncol = ncol or width
    else:
        values, bands = table_layers(spark, paths), [1] * len(paths)
        for c, r in (("t", layers), ("row", rows), ("col", cols)):
            values = values.where(F.col(c).between(*r)) if r else values
    n = sum(bands)
    if directory is not None and n != len(paths):
        raise ValueError("a file holds several layers; list the files and give their times")
    if time is not None:
        times = checked_times(time, n)
    elif cycle_type is not None:
        times = calendar_dates(cycle_type, start, n, end, time_anchor)
    elif directory is None:
        times = list(range(1, n + 1))
    sources = [p for p, k in zip(paths, bands) for _ in range(k)]
    names = unique_names([re.sub(r"\.[^.]*$", "", p.rsplit("/", 1)[-1]) for p in sources])
    listed = spark.createDataFrame([(k + 1, names[k], sources[k], str(times[k])) for k in range(n)], "t int, layer_name string, source string, time string")
    width = F.lit(ncol or values.agg(F.max("col")).first()[0])
    cell = ((F.col("row") - 1) * width + F.col("col")).cast("long")
    return Layers(values.select(F.lit(grid_id).alias("grid_id"), cell.alias("cell"), "row", "col", "t", "value"), listed, n)


def table_layers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(t, row, col, value) of Parquet or CSV layers as one scan; a row's file, or the folder its file is in, tells t."""
    encoded = [re.sub("^file:/+", "file:/", _filesystem(spark, p)[0].makeQualified(_filesystem(spark, p)[1]).toUri().toString()) for p in paths]
    if paths[0].endswith(".csv"):
        rows = spark.read.csv(list(paths), header=True, schema="row int, col int, value double")
    else:
        rows = spark.read.parquet(*paths)
    where = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    rows = rows.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"), where.alias("file"))
    places = spark.createDataFrame([(p, k + 1) for k, p in enumerate(encoded)], "file string, t int")
    own, above = (F.broadcast(places.withColumnRenamed("t", c)) for c in ("own", "above"))  # one row a file, listed by the caller
    rows = rows.join(own, "file", "left").withColumn("file", F.regexp_extract("file", "^(.*)/[^/]*$", 1)).join(above, "file", "left")
    return rows.select(F.coalesce("own", "above").alias("t"), "row", "col", "value")


def read_netcdf_stack(spark: SparkSession, paths: str | Sequence[str], var: str | None = None, layers: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, grid_id: str = "g") -> Layers:
    """Layers of a NetCDF cube by its times, which must be there and all differ; warns if they are less than a year apart."""
    values, times, (_, width) = netcdf.read_cube(spark, paths, var, layers, rows)
    gaps = [(b - a).total_seconds() / 86_400 for a, b in zip(times, times[1:]) if isinstance(a, datetime)]
    if gaps and 0 < statistics.median(gaps) < 300:
        warnings.warn(SEASONS, stacklevel=2)
    source = paths if isinstance(paths, str) else ", ".join(paths)
    listed = spark.createDataFrame([(k + 1, str(x), source, str(x)) for k, x in enumerate(times)], "t int, layer_name string, source string, time string")
    cell = ((F.col("row") - 1) * width + F.col("col")).cast("long")
    return Layers(values.select(F.lit(grid_id).alias("grid_id"), cell.alias("cell"), "row", "col", "t", "value"), listed, len(times))


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Entries of a directory on any file system Spark knows."""
    fs, p = _filesystem(spark, directory)
    if not fs.exists(p):
        raise ValueError(f"no such directory: {directory}")
    return sorted(x.getPath().toString() for x in fs.listStatus(p))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def long_from_cubes(cubes: DataFrame, time: str = "time", var: str | None = None) -> DataFrame:
    """Long rows (time, row, col, value, or one of several value columns named by ``var``) with t by order of time.

    Refuses missing times, repeated layers, and several variables without a choice.
    """
    variables = [c for c in cubes.columns if c not in (time, "row", "col", "grid_id")]
    if var is None:
        if len(variables) != 1:
            raise ValueError(f"several variables, choose one: {', '.join(variables)}")
        var = variables[0]
    if var not in variables:
        raise ValueError(f"no variable {var}")
    rows = cubes if "grid_id" in cubes.columns else cubes.withColumn("grid_id", F.lit("g"))
    bad = rows.agg(F.count_if(F.col(time).isNull()).alias("none"), F.count("*").alias("n")).first()
    if not bad["n"] or bad["none"]:
        raise ValueError("every row needs a time")
    if rows.groupBy("grid_id", time, "row", "col").count().where("count > 1").limit(1).count():
        raise ValueError("a layer is given twice")
    steps = rows.select("grid_id", time).distinct()
    steps = steps.withColumn("t", F.dense_rank().over(Window.partitionBy("grid_id").orderBy(time)))
    return rows.join(steps, ["grid_id", time]).select("grid_id", "row", "col", "t", F.col(time).alias("time"), F.col(var).cast("double").alias("value"))


def sub_annual(long: DataFrame) -> bool:
    """Whether the median gap between layers is under 300 days; warns if so, since trend tests assume no seasons."""
    steps = long.select("grid_id", "time").distinct()
    gap = F.datediff("time", F.lag("time").over(Window.partitionBy("grid_id").orderBy("time")))
    median = steps.withColumn("gap", gap).agg(F.median("gap")).first()[0]
    found = median is not None and 0 < median < 300
    if found:
        warnings.warn(SEASONS, stacklevel=2)
    return found


def example_data(name: str | None = None):
    """Names of the bundled example grids, or one of them as rows (row, col, t, value)."""
    examples = {"ramp": [(r, c, t, float(r + c + t)) for r in range(1, 4) for c in range(1, 4) for t in range(1, 6)]}
    if name is None:
        return sorted(examples)
    if name not in examples:
        raise ValueError(f"no example {name}")
    return examples[name]

"""A neighbourhood prepared once for a mask of valid cells, kept as a table, and reused by the contextual and spatial tests.

What depends on the mask is stored: each valid cell with its number of neighbours, bucketed by grid and cell, and for each grid the
number of valid cells, of links, and an order-free hash of the mask. A test that is given the topology refuses a grid of another shape,
another connectivity or window, and a field whose valid cells are not those of the mask.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.lineage import shared_dir
from gridloom.operators import spatial
from gridloom.operators.grid import GridSpec
from gridloom.operators.spatial import Neighbourhood, neighbourhood

BUCKETS = 16


@dataclass(frozen=True)
class Topology:
    around: Neighbourhood
    cells: DataFrame  # grid_id, cell, k
    masks: DataFrame  # grid_id, n, hash, s0

    def check(self, spec: GridSpec, connectivity: str, window_size: int, valid: DataFrame | None = None) -> None:
        """Refuse other geometry and settings and, where valid cells (grid_id, cell) are given, another mask."""
        self.around.check(spec, connectivity, window_size)
        if valid is not None:
            now = signature(valid).select("grid_id", F.struct("n", "hash").alias("now"))
            was = self.masks.select("grid_id", F.struct("n", "hash").alias("was"))
            if not now.join(was, "grid_id", "full").where(~F.col("now").eqNullSafe(F.col("was"))).isEmpty():
                raise ValueError("the topology was made for other valid cells")


def signature(valid: DataFrame, *more: Column) -> DataFrame:
    """grid_id, n and a hash of the valid cells (grid_id, cell) that does not depend on their order."""
    return valid.groupBy("grid_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cell")).alias("hash"), *more)


def prepare(cells: DataFrame, spec: GridSpec, connectivity: str = "queen", window_size: int = 3, valid: Column | str = "ok") -> Topology:
    """The topology of the valid cells of cells (grid_id, cell, row, col); its table is written to the shared folder."""
    spark, name = cells.sparkSession, f"topology_{uuid.uuid4().hex}"
    around = neighbourhood(spec, connectivity, window_size)
    rows = cells.where(valid).select("grid_id", "cell", "row", "col", F.lit(1.0).alias("one"))
    counted = spatial.lagged(rows, spec, connectivity, window_size, "one").select("grid_id", "cell", "k")
    counted.write.bucketBy(BUCKETS, "grid_id", "cell").sortBy("cell").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    stored = spark.table(name)
    masks = signature(stored, F.sum("k").alias("s0"))
    masks.write.parquet(f"{shared_dir(spark)}/{name}-masks")
    return Topology(around, stored, spark.read.parquet(f"{shared_dir(spark)}/{name}-masks"))


def local_statistic(topology: Topology, field: DataFrame, spec: GridSpec, value: str = "x", method: str = "moran") -> DataFrame:
    """The local statistics of a field over a topology, which its valid cells must have."""
    around = topology.around
    topology.check(spec, around.connectivity, around.window_size, field.where(F.col(value).isNotNull()))
    return spatial.local_statistic(field, spec, value, method, around.connectivity, around.window_size)


def global_statistic(topology: Topology, field: DataFrame, spec: GridSpec, value: str = "x", method: str = "moran") -> DataFrame:
    """The global statistic of a field over a topology, which its valid cells must have."""
    around = topology.around
    topology.check(spec, around.connectivity, around.window_size, field.where(F.col(value).isNotNull()))
    return spatial.global_statistic(field, spec, value, method, around.connectivity, around.window_size)


def with_neighbours(topology: Topology, cells: DataFrame) -> DataFrame:
    """cells with k, the number of neighbours; cells bucketed like the topology meet it where they are."""
    return cells.join(topology.cells, ["grid_id", "cell"], "left")

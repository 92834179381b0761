"""Helpers shared by the training-data operators: reading, checkpoints, guarded broadcasts, components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the byte-level contracts: runs without space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast up to this many rows of its checked count; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other alphabets)."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value's text, modulo m; null values count as the text ``null``."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir. Where none is named a folder of the
    driver serves a local master (as in tests); on a cluster that is refused, since executors would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return sc.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows from whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``most``; a lower one stays.

    Rows reach Python workers 10,000 or 64 MB at a time unless told otherwise. A column's buffer doubles as it fills, so each task
    then takes twice that beside the heap, its worker holds it again, and the executor's allocator keeps much of it for good.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, f"{most}b")


def with_text(docs: DataFrame, carry: tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """The carried columns and the text, and the text's place: behind the others unless it is carried itself."""
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), *([] if text in carry else [F.col(f"`{text}`").alias("__text")]))
    return rows, carry.index(text) if text in carry else len(carry)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; a lost executor then costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose count was checked against the bound; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has long columns a, b (self loops and repeats are allowed). Returns (node, component),
    one row for each node with an edge to another; component is the smallest node reachable.
    Each round is two aggregations joined back to the edges, so no vertex's neighbours meet in one
    task but for Spark's own skew-split joins; lineage is cut by a checkpoint each round.
    """
    cur = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(low, "a")
        nxt = (
            joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        cur = checkpointed(nxt)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def text_slices(column, rows: int = 500, most: int = 1 << 22):
    """The bytes of an Arrow column of texts (null: None), as lists of at most ``rows`` texts and ``most`` bytes
    (a longer text comes alone), with the place of each list's first text."""
    import numpy as np
    import pyarrow as pa

    raw = column.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    k = 0
    while k < len(raw):
        end = int(np.searchsorted(ends, ends[k] + most, "right")) - 1
        end = max(k + 1, min(end, k + rows, len(raw)))
        yield k, raw.slice(k, end - k).to_pylist()
        k = end


def pieces_of_text(text: bytes, size: int = 1 << 20):
    """A text in pieces of about ``size`` bytes, cut at white space, so that no word is parted."""
    if len(text) <= size:
        yield text
        return
    white, at = re.compile(rb"[\x20\x09-\x0D]"), 0
    while at < len(text):
        found = white.search(text, min(at + size, len(text)))
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def sorted_groups(batches, n_key: int):
    """From record batches sorted by their first n_key integer columns: (columns, starts) of whole groups.

    columns are numpy arrays (or Arrow arrays, where a column is not of numbers); starts holds each
    group's first row and the number of rows. The last group waits for the next batch, so memory is
    bounded by a batch and the largest group.
    """
    import numpy as np
    import pyarrow as pa

    rest = None
    schema = None

    def cut(rows):
        keys = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(n_key)]
        new = np.zeros(len(keys[0]), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    def whole(rows):
        return pa.Table.from_batches(rows, schema).combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        schema = b.schema
        rows = b if rest is None else whole([rest, b])[0]
        at = cut(rows)
        if at[-1]:
            done = rows.slice(0, int(at[-1]))
            yield done, np.append(at[:-1], done.num_rows)
        rest = rows.slice(int(at[-1]))
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def candidate_pairs(starts, home, limit: int = 2_000_000):
    """Within groups [starts[i], starts[i + 1]): (left, right) row numbers of every home row with every
    other row of its group; a pair of two home rows comes once. Yields chunks of about ``limit`` pairs."""
    import numpy as np

    size = np.diff(starts)
    group = np.repeat(np.arange(len(size)), size)
    homes = np.flatnonzero(home)
    homes = homes[size[group[homes]] > 1]
    reps = size[group[homes]]
    ends = np.cumsum(reps)
    lo = 0
    while lo < len(homes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        h, r = homes[lo:hi], reps[lo:hi]
        left = np.repeat(h, r)
        right = np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r) + np.repeat(starts[group[h]], r)
        keep = (right != left) & ~(home[right] & (right < left))
        yield left[keep], right[keep]
        lo = hi


def spanning_forest(n: int, home, near):
    """(m, 2) row numbers: a spanning forest of the links between a home row and any row of n rows.

    near(f, g) tells, for row numbers f and g, which pairs are alike, as a matrix.
    """
    import numpy as np

    out, left = [], np.arange(n)
    while len(left) > 1:
        seeds = left[home[left]]
        if not len(seeds):
            break
        frontier = seeds[:1]
        left = left[left != seeds[0]]
        while len(frontier) and len(left):
            take = max(1, 1_000_000 // len(left))
            f, frontier = frontier[:take], frontier[take:]
            alike = near(f, left) & (home[f][:, None] | home[left][None, :])
            hit = alike.any(0)
            if hit.any():
                out.append(np.stack([f[alike[:, hit].argmax(0)], left[hit]], 1))
                frontier = np.concatenate([frontier, left[hit]])
                left = left[~hit]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def dealt_in_blocks(rows: DataFrame, keys: tuple[str, ...], member: str, hot: DataFrame, most: int) -> DataFrame:
    """rows (keys, role, member, ...) with ``sub``: cells that hot lists with n rows are dealt as a grid of blocks.

    Members of a cell fall in ceil(n / most) blocks by hash. Sub-cell (i, j) holds the home rows (role 0) of block
    i and all rows of block j (role 1), so every home row meets every other row of its cell in one sub-cell, and
    no sub-cell holds more than two blocks. Sub-cells of a cell that is dealt are numbered from 1, those of two
    different blocks below 0; other cells have 0 alone.
    """
    if hot.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("long"))
    rest = [c for c in rows.columns if c != "role"]
    rows = rows.join(broadcast_if_small(hot), list(keys), "left").withColumn("g", F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member), F.col("g"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    number = lambda i, j: F.when(F.col("g") == 1, F.lit(0)).otherwise((i * F.col("g") + j + 1) * F.when(i == j, F.lit(1)).otherwise(F.lit(-1))).cast("long")
    as_home = rows.where("role = 0").select(*rest, "role", number(F.col("own"), F.col("i")).alias("sub"))
    as_any = rows.where("role = 1 or i <> own").select(*rest, F.lit(1).alias("role"), number(F.col("i"), F.col("own")).alias("sub"))
    return as_home.unionByName(as_any)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of highest ``n``, at most ``most`` of them: all above a level found from a histogram of n
    on a logarithmic scale (a few hundred rows reach the driver)."""
    level = F.floor(16 * F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(F.lit(False)) if least is None else counts.where(level >= least)

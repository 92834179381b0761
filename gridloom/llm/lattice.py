"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors on eight random orthonormal directions, scales them and takes the
nearest point of the E8 lattice as the vector's cell (a Gosset cell: 240 neighbours, covering radius 1).
A vector is entered in its own cell and in the ``PROBES`` neighbouring cells nearest to its projection;
in each cell the owners are compared with all entries by a 128-bit random-hyperplane sketch, which discards
pairs that are far apart. What remains is verified by the cosine of the vectors in double precision: single
pairs are joined with their vectors; in cells that hold more near pairs than entries, and in cells of more than ``CELL`` entries,
which are dealt as grids of blocks (dense cells), the entries with a near one are, and all cosines are taken there.

Links are counted, not listed. A pair that meets in several dense cells is counted in the first of them only: each entry
carries the dense cells it is in, at most one a table and probe. A pair that meets in none is counted where it is verified. So
a dense cell leaves one number per entry, and a spanning forest for the components, however many pairs it holds. Equal
vectors are one entry with a count, so a vector that fills a third of the table costs one row; rows find their vector's class by
128 bits of hash (by the vector itself, should two classes ever share these).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing (n_links 0, component their own id, kept). Vectors of different lengths never link. A null id is
never a component's id unless all of its ids are null; repeated rows are equal vectors.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import candidate_pairs, checkpointed, connected_components, dealt_in_blocks, partitions, sorted_groups, spanning_forest

COSINE = 0.95
TABLES = 4
PROBES = 8
SCALE = 5.0
CELL = 4_096
DENSE = 2  # near pairs per entry beyond which a cell's vectors are compared in the cell
SKETCH_SLACK = 32  # of 128 bits: at cosine 0.95 the mean is 13 and the deviation 3.4
SEED = 7


def shell() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = [np.zeros(8) for _ in range(112)]
    for v, (i, j, a, b) in zip(out, ((i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1))):
        v[i], v[j] = a, b
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out + halves)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    at = np.arange(len(x))
    odd = near.sum(1).astype(np.int64) % 2 != 0
    near[at, worst] += np.where(odd, np.where(off[at, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer points and those shifted by one half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(1, keepdims=True) <= ((x - b) ** 2).sum(1, keepdims=True), a, b)


def projection(dim: int, table: int) -> np.ndarray:
    rng = np.random.default_rng((SEED, dim, table))
    return np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]


def hyperplanes(dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim, 1_000)).normal(size=(dim, 128))


def pack(points: np.ndarray) -> np.ndarray:
    """Doubled lattice coordinates as the bytes of an integer."""
    return np.ascontiguousarray((2 * points).astype(np.int8)).view(np.int64)[..., 0]


def cells(unit: np.ndarray, directions: np.ndarray, neighbours: np.ndarray, scale: float = SCALE, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(own, near): each vector's own cell and its ``probes`` nearest neighbouring cells."""
    x = scale * unit @ directions
    own = decode(x)
    around = own[:, None, :] + neighbours[None]
    far = ((around - x[:, None, :]) ** 2).sum(2)
    nearest = np.argpartition(far, probes - 1, axis=1)[:, :probes]
    return pack(own), pack(np.take_along_axis(around, nearest[:, :, None], 1))


def _entries(scale: float, tables: int, probes: int):
    def run(batches):
        neighbours, planes, directions = shell(), {}, {}
        for b in batches:
            ids = b.column(0).to_numpy()
            values = b.column(1)
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy().astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim], directions[dim] = hyperplanes(dim), [projection(dim, t) for t in range(tables)]
                for k in range(0, len(at), 512):
                    rows = at[k : k + 512]
                    v = flat[starts[rows][:, None] + np.arange(dim)]
                    v = v / np.abs(v).max(1, keepdims=True)
                    v /= np.sqrt((v * v).sum(1, keepdims=True))
                    sketch = np.packbits(v @ planes[dim] > 0, axis=1).view(np.int64)
                    for t in range(tables):
                        own, near = cells(v, directions[dim][t], neighbours, scale, probes)
                        n = len(rows)
                        cell = np.concatenate([own, near.ravel()])
                        who = np.concatenate([np.arange(n), np.repeat(np.arange(n), probes)])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(cell), dim * 1_000 + t, np.int64)), pa.array(cell),
                                pa.array((np.arange(len(cell)) >= n).astype(np.int32)), pa.array(ids[rows][who]),
                                pa.array(sketch[who, 0]), pa.array(sketch[who, 1]),
                            ],
                            names=["tab", "cell", "role", "cid", "s0", "s1"],
                        )

    return run


def _candidates(slack: int):
    """Entries by (tab, cell, sub) -> near pairs (a, b), and the near entries of dense cells (b null, with their key)."""

    def run(batches):
        for rows, starts in sorted_groups(batches, 3):
            home, cid = rows.column(3).to_numpy() == 0, rows.column(4).to_numpy()
            s0, s1 = (rows.column(i).to_numpy().view(np.uint64) for i in (5, 6))
            size, dealt = np.diff(starts), rows.column(2).to_numpy()[starts[:-1]] != 0
            found, active, kept = np.zeros(len(size), np.int64), np.zeros(len(cid), bool), []
            for left, right in candidate_pairs(starts, home):
                near = np.bitwise_count(s0[left] ^ s0[right]).astype(np.int16) + np.bitwise_count(s1[left] ^ s1[right]) <= slack
                left, right = left[near], right[near]
                if not len(left):
                    continue
                active[left] = active[right] = True
                group = np.searchsorted(starts, left, "right") - 1
                found += np.bincount(group, minlength=len(size))
                few = (found[group] <= DENSE * size[group]) & ~dealt[group]
                kept.append(np.stack([left[few], right[few]], 1))
            if not kept:
                continue
            dense = (found > DENSE * size) | dealt
            pairs = np.concatenate(kept)
            pairs = cid[pairs[~dense[np.searchsorted(starts, pairs[:, 0], "right") - 1]]]
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            at = np.flatnonzero(active & np.repeat(dense, size))
            key = [rows.column(i).to_numpy()[at] for i in range(4)]
            none = np.zeros(len(pairs), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate([none, k]), pa.int64()) for k in key), pa.array(np.concatenate([pairs[:, 0], cid[at]])),
                 pa.array(np.concatenate([pairs[:, 1], at]), mask=np.arange(len(pairs) + len(at)) >= len(pairs))],
                names=["tab", "cell", "sub", "role", "a", "b"],
            )

    return run


def _unit(column) -> np.ndarray:
    """Equally long vectors as rows of length one."""
    v = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


LINKS = "a long, others long, low long"


def _counts(a: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(a, rows linked with a), summed."""
    ids, back = np.unique(a, return_inverse=True)
    sums = np.zeros(len(ids), np.int64)
    np.add.at(sums, back, n)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums), pa.nulls(len(ids), pa.int64())], names=["a", "others", "low"])


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links that connect what is connected, without counts."""
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "others", "low"])


def _met(x: list | None, y: list | None) -> bool:
    """Whether two entries meet in a dense cell: both are in it, one of them at home."""
    own = {(d["tab"], d["cell"]): d["role"] for d in x or ()}
    return any(own[d["tab"], d["cell"]] * d["role"] == 0 for d in y or () if (d["tab"], d["cell"]) in own)


def _pair_links(cosine: float):
    """(a, b, na, nb, va, vb, da, db) -> LINKS, but for pairs that meet in a dense cell."""

    def run(batches):
        for rows in batches:
            a, b, na, nb = (rows.column(i).to_numpy() for i in range(4))
            sizes = [np.diff(rows.column(i).offsets.to_numpy()) for i in (4, 5)]
            for dim in np.unique(sizes[0][sizes[0] == sizes[1]]):
                at = np.flatnonzero((sizes[0] == dim) & (sizes[1] == dim))
                for k in range(0, len(at), 4_096):
                    pick = at[k : k + 4_096]
                    x, y = (_unit(rows.column(i).take(pa.array(pick))) for i in (4, 5))
                    p = pick[(x * y).sum(1) >= cosine]
                    cells = [rows.column(i).take(pa.array(p)).to_pylist() for i in (6, 7)]
                    p = p[[not _met(d, e) for d, e in zip(*cells)]] if len(p) else p
                    if len(p):
                        yield _counts(np.concatenate([a[p], b[p]]), np.concatenate([nb[p], na[p]]))
                        yield _forest(a[p], b[p])

    return run


def _dense_cells(column, cell: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell's entries: which are at home in it; and for the dense cells before it that hold two of them or more (columns), who is
    in them and who is at home there."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    tab, place, role = (flat.field(f).to_numpy() for f in ("tab", "cell", "role"))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    here = np.zeros(len(sizes), bool)
    here[owner[(tab == cell[0]) & (place == cell[1]) & (role == 0)]] = True
    before = (tab < cell[0]) | ((tab == cell[0]) & (place < cell[1]))
    if not before.any():
        return here, np.zeros((len(sizes), 0), np.float32), np.zeros((len(sizes), 0), np.float32)
    found, number, n = np.unique(np.stack([tab, place], 1)[before], axis=0, return_inverse=True, return_counts=True)
    inside, home = (np.zeros((len(sizes), len(found)), np.float32) for _ in range(2))
    inside[owner[before], number], home[owner[before], number] = 1, role[before] == 0
    return here, inside[:, n > 1], home[:, n > 1]


def _cell_links(cosine: float):
    """(tab, cell, sub, role, cid, n, v, dense) by cell -> LINKS, from the cosines of home entries with all entries of their cell."""

    def run(batches):
        for rows, starts in sorted_groups(batches, 3):
            for lo, hi in zip(starts[:-1], starts[1:]):
                part = rows.slice(int(lo), int(hi - lo))
                home, cid, n = part.column(3).to_numpy() == 0, part.column(4).to_numpy(), part.column(5).to_numpy()
                v = _unit(part.column(6))
                here, inside, at_home = _dense_cells(part.column(7), tuple(part.column(i)[0].as_py() for i in range(2)))

                def near(f, g, v=v):
                    c = v[f] @ v[g].T
                    for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-12)):  # a product's last digits depend on its blocks
                        c[i, j] = (v[f[i]] * v[g[j]]).sum()
                    return c >= cosine

                homes, every = np.flatnonzero(home), np.arange(len(cid))
                two_blocks = part.column(2)[0].as_py() < 0  # pairs of its homes meet in the block of their own
                step, sums = max(1, 2_000_000 // len(cid)), np.zeros(len(cid), np.int64)
                for k in range(0, len(homes), step):
                    f = homes[k : k + step]
                    alike = near(f, every)
                    alike[np.arange(len(f)), f] = False
                    if two_blocks:
                        alike[:, homes] = False
                    if inside.shape[1]:
                        alike &= at_home[f] @ inside.T + inside[f] @ at_home.T == 0
                    sums[f] += alike @ n
                    sums += np.where(here, 0, n[f] @ alike)  # pairs of two rows at home come from both sides, in this block or the mirrored one
                yield _counts(cid[sums > 0], sums[sums > 0])
                forest = spanning_forest(len(cid), home, near)
                if len(forest):
                    yield _forest(cid[forest[:, 0]], cid[forest[:, 1]])

    return run


def usable(v):
    """Columns expression: a vector with a direction."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def hashed(vectors: DataFrame) -> DataFrame:
    """vectors with h, 128 bits that equal vectors share; -0 counts as 0."""
    v = F.transform("v", lambda x: x + F.lit(0.0))
    return vectors.withColumn("v", v).withColumn("h", F.struct(*(F.xxhash64(F.lit(k), "v").alias(f"h{k}") for k in (1, 2))))


def classes_of(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: cid, h, v, low (smallest id), n (rows)."""
    rows = hashed(vectors.where(usable(F.col("v")))).groupBy("h", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("cid"), "h", "v", "low", "n"))


def links(
    classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, slack: int = SKETCH_SLACK, cell: int = CELL,
) -> DataFrame:
    """Links found between classes (cid, v, n): rows (a, others) whose sum is the number of rows linked with a, and rows
    (a, low) of a forest that connects what is linked."""
    parts = partitions(classes.sparkSession)
    key = ("tab", "cell")
    entries = classes.select("cid", "v").mapInArrow(_entries(scale, tables, probes), "tab long, cell long, role int, cid long, s0 long, s1 long")
    hot = checkpointed(entries.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > cell))
    dealt = dealt_in_blocks(entries, key, "cid", hot, cell).select(*key, "sub", "role", "cid", "s0", "s1")
    dealt = dealt.repartition(parts, *key, "sub").sortWithinPartitions(*key, "sub")
    found = checkpointed(dealt.mapInArrow(_candidates(slack), "tab long, cell long, sub long, role long, a long, b long"))
    dense = found.where("b is null").withColumnRenamed("a", "cid").drop("b")
    cells_of = dense.groupBy("cid", *key).agg(F.min("role").alias("role")).groupBy("cid")
    cells_of = checkpointed(cells_of.agg(F.collect_list(F.struct(*key, "role")).alias("dense")))  # a cell a table and probe at most
    side = lambda c: classes.join(cells_of, "cid", "left").select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("v").alias(f"v{c}"), F.col("dense").alias(f"d{c}"))
    pairs = found.where("b is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb", "da", "db")
    inside = dense.join(classes.select("cid", "n", "v"), "cid").join(cells_of, "cid")
    inside = inside.select(*key, "sub", "role", "cid", "n", "v", "dense").repartition(parts, *key, "sub").sortWithinPartitions(*key, "sub")
    return pairs.mapInArrow(_pair_links(cosine), LINKS).unionByName(inside.mapInArrow(_cell_links(cosine), LINKS))


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept."""
    vectors = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    classes = classes_of(vectors)
    found = checkpointed(links(classes, cosine, cell=cell))
    others = found.where("others is not null").groupBy("a").agg(F.sum("others").alias("others"))
    labels = connected_components(found.where("low is not null").select("a", F.col("low").alias("b")))
    known = classes.join(others.withColumnRenamed("a", "cid"), "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("h", "v", "low", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("group"))
    lowest = known.groupBy("group").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "group").select("h", "v", "n_links", "component_id")
    shared = not classes.groupBy("h").count().where("count > 1").isEmpty()
    on = ["h", "v"] if shared else ["h"]
    found = hashed(vectors.where(usable(F.col("v")))).select("vec_id", *on).join(known.select(*on, "n_links", "component_id"), on).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~F.coalesce(usable(F.col("v")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

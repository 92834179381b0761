"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Five blocks of 13, 13, 13, 13 and 12 bits give four
tables, the block pairs (0,1), (1,2), (0,2), (3,4). Two fingerprints that differ in at most 4 bits differ
in at most one bit of some table's two blocks: either the last pair holds at most one of the bits, or
two or more of them, and then the first three blocks hold at most two, of which some pair of the three
has at most one. So each table is searched with threshold 1.

A table's anchors are the words of a covering code: a perfect Hamming code (covering radius 1) on 15 of
its bits and the plain bits (radius 0) on the others. A fingerprint's home is its nearest anchor. It is
replicated to every anchor within covering radius plus threshold (seven code words at distance two, or
one plain bit flipped). Of two fingerprints that differ in at most one bit, each is replicated to the
other's home. In each anchor's cell homes are compared with all replicas by exact Hamming distance.

Rows with equal fingerprints are one vertex, so groups of exact copies cost one row. A cell emits a
spanning forest of its links, never all pairs. Cells with more than ``CELL`` homes are dealt as a grid
of (home block, replica block) sub-cells, which bounds memory and loses no link.

Defined cases: null and empty texts, and texts without words, have fingerprint 0 and link like any
other; null ids are carried along and never chosen as a component's id unless all ids of it are null;
repeated rows get the same component; columns beyond id and text are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import jaccard
from gridloom.llm.common import candidate_pairs, checkpointed, connected_components, dealt_in_blocks, partitions, sorted_groups, spanning_forest

SEED = 42
BITS = 64
THRESHOLD = 4
SIMILARITY = 0.8  # of shingle sets, for keep_one
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits)
TABLES = ((0, 1), (1, 2), (0, 2), (3, 4))
CODE = 15  # bits of the Hamming code
CELL = 8_192
CHUNK = 65_536


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of a text's ``width``-word shingles (signed, as Spark stores it)."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return int.from_bytes(xxh64_digest(line, SEED), "big", signed=True)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    ends = ends[width - 1 :]
    n, counts = len(starts), np.zeros(BITS, np.int64)
    for k in range(0, n, CHUNK):
        digests = b"".join([xxh64_digest(line[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fp`` (long), one row per row of docs."""
    types = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            fp = [fingerprint(x or b"", width) for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names=[*b.schema.names[:-1], "fp"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "fp long"])
    return docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 15-bit word: its syndrome, its code word, and the seven code words at distance two (if the syndrome is not 0)."""
    word = np.arange(1 << CODE)
    syndrome = np.zeros(1 << CODE, np.int64)
    for i in range(CODE):
        syndrome ^= np.where(word >> i & 1, i + 1, 0)
    home = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
    pairs = np.zeros((CODE + 1, 7), np.int64)
    for s in range(1, CODE + 1):
        pairs[s] = [(1 << a - 1) | (1 << b - 1) for a in range(1, CODE + 1) for b in range(a + 1, CODE + 1) if a ^ b == s]
    return syndrome, home, word[:, None] ^ pairs[syndrome]


def cover(fp: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, home, row): the anchors of each fingerprint over all tables; home marks its own anchor, row its place in fp."""
    syndrome, home, near = _code_tables()
    bits, at = fp.view(np.uint64), np.arange(len(fp))
    cells, own, rows = [], [], []
    for t, (i, j) in enumerate(TABLES):
        (a, na), (b, nb) = BLOCKS[i], BLOCKS[j]
        u = ((bits >> np.uint64(a)) & np.uint64((1 << na) - 1)).astype(np.int64) << nb | ((bits >> np.uint64(b)) & np.uint64((1 << nb) - 1)).astype(np.int64)
        code, plain = u & (1 << CODE) - 1, u >> CODE
        anchor = lambda c, p, t=t: np.int64(t) << 40 | p << CODE | c
        cells.append(anchor(home[code], plain))
        own.append(np.ones(len(fp), bool))
        rows.append(at)
        if homes_only:
            continue
        off = np.flatnonzero(syndrome[code])
        cells.append(anchor(near[code[off]], plain[off, None]).ravel())
        rows.append(np.repeat(off, 7))
        for k in range(na + nb - CODE):
            cells.append(anchor(home[code], plain ^ (1 << k)))
            rows.append(at)
        own.append(np.zeros(sum(map(len, rows)) - sum(map(len, own)), bool))
    return np.concatenate(cells), np.concatenate(own), np.concatenate(rows)


def _cover_rows(homes_only: bool):
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 2_000):
                part = fp[k : k + 2_000]
                cell, home, row = cover(part, homes_only)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((~home).astype(np.int32)), pa.array(part[row])], names=["cell", "role", "fp"])

    return run


def spanning_links(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Spanning forest, as (m, 2) row numbers, of the links between a home row and any row."""
    bits = fp.view(np.uint64)
    return spanning_forest(len(fp), home, lambda f, g: np.bitwise_count(bits[f][:, None] ^ bits[g][None, :]) <= threshold)


def _link_cells(threshold: int, big: int = 4_096):
    def run(batches):
        for rows, starts in sorted_groups(batches, 2):
            home = rows.column(2).to_numpy() == 0
            fp = rows.column(3).to_numpy()
            bits = fp.view(np.uint64)
            links = []
            size = np.diff(starts)
            large = size > big
            for g in np.flatnonzero(large):
                at = slice(starts[g], starts[g + 1])
                links.append(spanning_links(fp[at], home[at], threshold) + starts[g])
            small = home & ~np.repeat(large, size)
            for left, right in candidate_pairs(starts, small):
                near = np.bitwise_count(bits[left] ^ bits[right]) <= threshold
                left, right = left[near], right[near]
                if not len(left):
                    continue
                group = np.searchsorted(starts, left, "right") - 1
                many = np.bincount(group, minlength=len(size)) > size  # more links than rows: a forest says the same
                keep = ~many[group]
                links.append(np.stack([left[keep], right[keep]], 1))
                for g in np.flatnonzero(many):
                    at = slice(starts[g], starts[g + 1])
                    links.append(spanning_links(fp[at], home[at], threshold) + starts[g])
            if links:
                both = np.concatenate(links)
                pairs = np.unique(np.sort(fp[both], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def link(fps: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are within the threshold.

    fps has the distinct fingerprints in column fp.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the tables cover up to {THRESHOLD} differing bits")
    homes = fps.select("fp").mapInArrow(_cover_rows(True), "cell long, role int, fp long")
    hot = checkpointed(homes.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell))
    rows = fps.select("fp").mapInArrow(_cover_rows(False), "cell long, role int, fp long")
    rows = dealt_in_blocks(rows, ("cell",), "fp", hot, cell).select("cell", "sub", "role", "fp")
    dealt = rows.repartition(partitions(fps.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub")
    return dealt.mapInArrow(_link_cells(threshold), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id), one row per row of docs.

    group is the smallest fingerprint of the component; component_id its smallest id.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    rows = checkpointed(fingerprints(keyed, "text", width, ("doc_id", "text_hash")))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = connected_components(link(distinct, threshold))
    grouped = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("group"))
    lowest = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    named = grouped.select("fp", "group").join(lowest, "group")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    rows = components(docs, id_col, text)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = SIMILARITY, complete: bool = False) -> DataFrame:
    """docs with one row of each group of similar texts: its smallest id; among rows that share that id, one of the smallest text hash.

    Pairs of Jaccard 0.8 differ in about 10 bits of 64, beyond what the tables here cover, so candidates come from the
    wider SimHashes of ``widebits``, and ``jaccard`` verifies them. Such candidates are found with high probability; with
    ``complete`` the pairs they leave out are found as well.
    """
    rows = checkpointed(jaccard.groups(docs, id_col, text, width, similarity, complete=complete))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    chosen = rows.groupBy("group").agg(first.alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
    repeats = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    chosen = checkpointed(chosen.join(repeats, chosen["id"].eqNullSafe(repeats["doc_id"]) & chosen["hash"].eqNullSafe(repeats["text_hash"])).select("id", "hash", "n"))
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = renamed.join(chosen, F.col(place[id_col]).eqNullSafe(F.col("id")) & F.xxhash64(F.col(place[text])).eqNullSafe(F.col("hash")))
    own = [F.col(p).alias(c) for c, p in place.items()]
    single = kept.where("n = 1").select(*own)
    if chosen.where("n > 1").isEmpty():
        return single
    return single.unionByName(kept.where("n > 1").dropDuplicates(["id", "hash"]).select(*own))

"""Alignment of two tokenizers, and how often their tokens stand together in the corpus.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (pieces with byte fallback) the text, before which it
puts a space itself. Tokens of A and B whose byte ranges overlap are the edges of a bipartite graph; union-find gives
its connected components, which are exactly the minimal groups: the stretches between byte offsets where tokens of
both end. All members of a group are linked, A with B.

Texts are cut at single spaces between characters that are no white space. No token of either kind reaches over such
a cut, so a task encodes and aligns each distinct chunk once, while it remembers it, and a document is a list of the
chunks of its block of about ``BLOCK`` bytes of text. Counting is distributed: a block counts in how many of its documents each pair of ids is
linked, Spark adds these counts by pair, finds each A id's highest, and sends the totals of a block's pairs back to it,
where chunks and then documents are summed. Blocks are written once to the shared folder (what is read back is
that, whatever executors are lost); a block's task holds its chunks and pairs, never the corpus's.

Defined cases: null and empty texts, and those whose tokens do not give their bytes back (a U+2581 in a text becomes a
space), have no tokens: zeros and an empty digest; a text of white space only is one chunk; a text without single
spaces is one chunk whatever its length; groups of many tokens link distinct ids with multiplicities; repeated rows
count as documents each, null ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import shared_dir, text_slices
from gridloom.llm.wordbpe import byte_letters

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
BLOCK = 12 << 20
HELD = 500_000  # chunks a task remembers from block to block
RUN = 1 << 16  # characters that are encoded in one call
SPACE = re.compile(r"(?<=\S) (?=\S)")
DOCS, CHUNKS, PAIRS = range(3)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def public_tokenizers_ab() -> tuple[str, bytes]:
    """A's JSON and B's model, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARIES[0]), encoding="utf-8") as a, open(public_tokenizers.path(VOCABULARIES[1]), "rb") as b:
        return a.read(), b.read()


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 with edges a-b: each node's smallest reachable node. All roots are joined
    to the smaller one at a time, then paths are halved until they are flat."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, numbered from the left, from the byte offsets where they end."""
    cuts = np.union1d(ends_a, ends_b)  # between two of these lies one overlap
    labels = united(len(ends_a) + len(ends_b), np.searchsorted(ends_a, cuts), len(ends_a) + np.searchsorted(ends_b, cuts))
    first, of_a = np.unique(labels[: len(ends_a)], return_inverse=True)
    return of_a, np.searchsorted(first, labels[len(ends_a) :])


def distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often), sorted."""
    keys, n = np.unique(group << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i] - 1, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Aligner:
    """Encodes and aligns chunks of text."""

    def __init__(self, sources: tuple[str, bytes]):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(sources[0]), SentencePieceProcessor(model_proto=sources[1])
        self.a.encode_special_tokens = True
        letters, read = byte_letters(), json.loads(sources[0])
        names = read["model"]["vocab"] | {t["content"]: t["id"] for t in read["added_tokens"]}
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[c] for c in name)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece reaches over a space, so texts cannot be cut at spaces")
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        digits = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.comma, self.semi, self.bar = ([c + d for d in digits] for c in (b",", b";", b"|"))

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B for a space and the text; None where they do not give its bytes."""
        a, b, raw = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode()
        return (a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw else None

    def align(self, chunks: list[str], joined: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For chunks, each after a space: counts (chunks x 4), their groups as text (each after a ``;``), whether they have
        tokens, then all links: how many a chunk has, the pairs of ids, and how often each is linked.

        joined: chunks may be encoded one after another in a text.
        """
        ids_a: list[list[int]] = []
        ids_b: list[list[int]] = []
        good = np.ones(len(chunks), bool)
        k = 0
        while k < len(chunks):
            stop, size = k + 1, len(chunks[k])
            while joined and stop < len(chunks) and size < RUN:
                size += 1 + len(chunks[stop])
                stop += 1
            found = self.encode(" ".join(chunks[k:stop]))
            if found is None and stop > k + 1:
                for i in range(k, stop):
                    one = self.encode(chunks[i])
                    good[i] = one is not None
                    ids_a.append(one[0] if one else [])
                    ids_b.append(one[1] if one else [])
            elif found is None:
                good[k] = False
            else:
                ids_a.append(found[0])
                ids_b.append(found[1])
            k = stop
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (ids_a, ids_b))
        sizes = np.array([len(c.encode()) + 1 if g else 0 for c, g in zip(chunks, good.tolist())])
        ends_a, ends_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(sizes)
        chunk_a, chunk_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        ga, gb = grouped(ends_a, ends_b)
        n_groups = int(ga[-1]) + 1 if len(ga) else 0
        in_a, in_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        chunk_g = chunk_a[np.cumsum(in_a) - in_a]
        each = len(chunks)
        counts = np.stack([np.bincount(chunk_a, minlength=each), np.bincount(chunk_b, minlength=each), np.bincount(chunk_g, minlength=each), np.zeros(each, np.int64)], 1).astype(np.int64)
        np.add.at(counts[:, 3], chunk_g, in_a * in_b)
        # the groups as text
        first_a, first_b = np.diff(ga, prepend=-1) > 0, np.diff(gb, prepend=-1) > 0
        parts = np.empty(len(a) + len(b), object)
        comma, semi, bar = self.comma, self.semi, self.bar
        parts[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga]] = [semi[i] if f else comma[i] for i, f in zip(a.tolist(), first_a.tolist())]
        parts[np.arange(len(b)) + np.cumsum(in_a)[gb]] = [bar[i] if f else comma[i] for i, f in zip(b.tolist(), first_b.tolist())]
        listed, stops = parts.tolist(), np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        texts = [b"".join(listed[x:y]) for x, y in zip([0, *stops], stops)]
        # the links: distinct ids of a group, all of A with all of B
        g, id_a, times_a = distinct(ga, a)
        h, id_b, times_b = distinct(gb, b)
        some = np.bincount(h, minlength=n_groups)
        right = ragged((np.cumsum(some) - some)[g], some[g])
        left = np.repeat(np.arange(len(g)), some[g])
        return counts, texts, good, np.bincount(chunk_g[g[left]], minlength=each), id_a[left] << 32 | id_b[right], times_a[left] * times_b[right]


class Known:
    """The chunks a task has met: numbers by chunk, and by number what the alignment gave."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.clean: dict[str, int] = {}
        self.odd: dict[str, int] = {}  # pieces with white space at an end, inside runs, or at the ends of a text
        self.texts: list[bytes] = []
        self.parts: list[list[np.ndarray]] = []

    def learn(self, chunks: list[str], into: dict[str, int], joined: bool) -> None:
        into.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks))))
        counts, texts, good, links, keys, times = self.aligner.align(chunks, joined)
        self.texts += texts
        self.parts.append([counts, good, links, keys, times.astype(np.int32)])

    def tables(self) -> list[np.ndarray]:
        """counts and good by chunk, links by chunk, then keys and times by link."""
        if len(self.parts) > 1:
            self.parts = [[np.concatenate(x) for x in zip(*self.parts)]]
        return self.parts[0] if self.parts else [np.zeros((0, 4), np.int64), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))]


class BlockOf:
    """The documents of one block as lists of known chunks."""

    def __init__(self, known: Known):
        self.known, self.size = known, 0
        self.ids, self.chunks, self.digests = [], [], []

    def add(self, ids: list, texts: list[bytes | None]) -> None:
        known, plain, pieces = self.known, [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace") if raw else ""
            plain.append(text.split(" ") if text else [])
            self.size += len(raw or b"")
        new = set(chain.from_iterable(plain)).difference(known.clean)
        unclean = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        cut = [bool(unclean) and not unclean.isdisjoint(chunks) for chunks in plain]
        for chunks, odd in zip(plain, cut):
            pieces.append(SPACE.split(" ".join(chunks)) if odd else chunks)
        if new := list(new - unclean):
            known.learn(new, known.clean, True)
        if new := list({c for chunks, odd in zip(pieces, cut) if odd for c in chunks}.difference(known.odd)):
            known.learn(new, known.odd, False)
        for chunks, odd in zip(pieces, cut):
            numbers = list(map((known.odd if odd else known.clean).__getitem__, chunks))
            self.chunks.append(np.array(numbers, np.int32))
            self.digests.append(hashlib.sha256(b"".join(map(known.texts.__getitem__, numbers))[1:]).hexdigest() if numbers else "")
        self.ids += ids

    def rows(self, number: int, kind: pa.DataType):
        """The block's documents, its chunks' links, and in how many of its documents each pair is linked."""
        counts, good, links, keys, times = self.known.tables()
        sizes = np.fromiter(map(len, self.chunks), np.int64, len(self.chunks))
        used, flat = np.unique(np.concatenate([*self.chunks, np.zeros(0, np.int32)]), return_inverse=True)
        starts = (np.cumsum(links) - links)[used]
        counts, good, links = counts[used], good[used], links[used]
        at = ragged(starts, links)
        pairs, local = np.unique(keys[at], return_inverse=True)
        times, starts, n = times[at], np.cumsum(links) - links, np.zeros(len(pairs), np.int64)
        sums, ends, kept = np.zeros((len(self.ids), 4), np.int64), np.cumsum(sizes), []
        for k, (lo, hi) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            chunks = flat[lo:hi]
            if not good[chunks].all():
                chunks, self.digests[k] = chunks[:0], ""
            elif hi > lo:
                sums[k] = counts[chunks].sum(0)
                n[local[ragged(starts[chunks], links[chunks])]] += 1  # a pair that comes again in the document is counted once
            kept.append(chunks)
        offsets = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int32)))]
        yield _rows(DOCS, number, pa.array(self.ids, kind), [pa.array(x) for x in sums.T], pa.array(self.digests, pa.string()), lists)
        for role, arrays in ((CHUNKS, (links, local, times)), (PAIRS, (pairs >> 32, pairs & 0xFFFFFFFF, n))):
            yield _rows(role, number, pa.nulls(1, kind), [pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), [pa.array([x], pa.list_(pa.int32())) for x in arrays])


def _rows(role: int, block: int, ids: pa.Array, counts: list[pa.Array], digests: pa.Array, lists: list[pa.Array]) -> pa.RecordBatch:
    n = len(ids)
    lists = lists + [pa.nulls(n, pa.list_(pa.int32()))] * (3 - len(lists))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, role, np.int32)), pa.array(np.full(n, block)), ids, *counts, digests, *lists], names=["role", "block", "doc_id", *COUNTS, "digest", "x", "y", "z"])


def blocks(docs: DataFrame, sources: tuple[str, bytes], id_col: str, text: str, block: int) -> DataFrame:
    """Rows of three roles: documents as lists of chunks, chunks as lists of links, pairs with their documents."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind, shared = dict(rows.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(sources)

    def run(batches):
        known, open_block, number, ids = Known(Aligner(shared.value)), None, TaskContext.get().partitionId() << 32, None
        for b in batches:
            ids = b.column(0).type
            for k, some in text_slices(b.column(1)):
                open_block = open_block or BlockOf(known)
                open_block.add(b.column(0).slice(k, len(some)).to_pylist(), some)
                if open_block.size >= block:
                    yield from open_block.rows(number, ids)
                    open_block, number = None, number + 1
                    if len(known.texts) > HELD:
                        known = Known(known.aligner)
        if open_block:
            yield from open_block.rows(number, ids)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"role int, block long, doc_id {kind}, {counts}, digest string, x array<int>, y array<int>, z array<int>")


def pair_counts(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, place, a, b, n) of the blocks' pairs, and (a, b, total, best) of the corpus's: in how many documents the
    pair is linked, and whether no other pair of its A id is in more."""
    own = stored.where(F.col("role") == PAIRS).select("block", F.posexplode(F.arrays_zip("x", "y", "z")).alias("place", "p")).select("block", "place", F.col("p.x").alias("a"), F.col("p.y").alias("b"), F.col("p.z").cast("long").alias("n"))
    total = own.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = total.groupBy("a").agg(F.max("total").alias("highest"))  # at most one row an id of A's vocabulary
    return own, total.join(F.broadcast(highest), "a").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sources: tuple[str, bytes] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"
    made = blocks(docs, sources or public_tokenizers_ab(), id_col, text, block)
    made.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    own, total = pair_counts(stored)
    back = own.join(total, ["a", "b"]).select(F.col("block").alias("of"), "place", "total", "best")
    kind = dict(made.dtypes)["doc_id"]
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def sums(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        role = rows.column("role").to_numpy()
        links, local, times = (_flat(rows.column(c), role == CHUNKS) for c in "xyz")
        total, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs.column("place").to_numpy()
        total[place], best[place] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        ends = np.cumsum(links)
        mine = rows.filter(pa.array(role == DOCS))
        chunks = _flat(rows.column("x"), role == DOCS)
        sizes = np.array([0 if x is None else x for x in mine.column("x").combine_chunks().value_lengths().to_pylist()], np.int64)
        out = []
        for value in (best, total):
            running = np.append(0, np.cumsum(value[local] * times))
            by_chunk = running[ends] - running[ends - links]
            running = np.append(0, np.cumsum(by_chunk[chunks]))
            out.append(running[np.cumsum(sizes)] - running[np.cumsum(sizes) - sizes])
        return pa.table([mine.column("doc_id"), *(mine.column(c) for c in COUNTS), *map(pa.array, out), mine.column("digest")], names=names)

    left = stored.where(F.col("role") != PAIRS).groupBy("block")
    longs = ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum"))
    return left.cogroup(back.groupBy("of")).applyInArrow(sums, f"doc_id {kind}, {longs}, groups_sha256 string")


def _flat(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The values of a list column's chosen rows, one after another."""
    return column.filter(pa.array(rows)).combine_chunks().flatten().to_numpy().astype(np.int64)

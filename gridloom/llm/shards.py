"""Training-order materialisation of token ids.

Each task packs the tokens of its texts, each text closed by an end-of-text id, in sequences of
``LENGTH`` ids; the last sequence of a task is filled up with end-of-text ids. Sequences are numbered
task by task. A keyed Feistel permutation of the numbers [0, n), made from one of the next even power of
two by cycle-walking (numbers that leave the range are permuted again until they fall in it), gives every
sequence its global slot in training order. Slots are dealt by range to shards, each task writes one
shard, and every record has the same number of bytes, so slot s is record s mod ``PER_SHARD`` of shard
s div ``PER_SHARD``: a reader resumes at any slot by one seek.

A record is the ids as little-endian 16-bit numbers (32-bit for larger vocabularies) and one line feed.
Shards go through Spark's own writer, so they land in any store it knows, and a task that is lost or run
twice leaves one committed file.

The tokens are made once: sequences, and where each text's ids lie among its task's ids, are written to the
shared folder; sequences are then numbered by one row per task, and shuffled once, compressed one by one, to their slots. Sequences and
places come from the same committed files, whatever order the rows had. Texts are encoded some megabytes at a time.

Defined cases: null and empty texts are one end-of-text id; repeated rows and rows without id are packed
like others (doc_ids lists no null ids); an empty table has no sequences and no shards; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import public_vocabulary
from gridloom.llm.common import checkpointed, discard, shared_dir, text_slices

LENGTH = 2_048
PER_SHARD = 4_096
KEY = 0x5EED
FEISTEL_ROUNDS = 6
PIECE = 1 << 20
LEVEL = 9
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")  # always begins a match of the pattern, so ids on both sides are the same apart


def permute(x: np.ndarray, n: int, key: int = KEY, rounds: int = FEISTEL_ROUNDS) -> np.ndarray:
    """The keyed permutation of [0, n): a Feistel network on twice ``half`` bits, walked until it is in range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}-{i}".encode(), digest_size=8).digest(), "little")) for i in range(rounds)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(31)) & low)
        return left << np.uint64(half) | right

    out = network(np.asarray(x).astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


class Encoder:
    """Texts to ids by tiktoken, each closed by the end-of-text id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kind = id_type(ranks)
        self.end = len(ranks)
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def text(self, raw: bytes | None) -> bytes:
        """The ids of one text, little end first."""
        text, parts, at = raw.decode("utf-8", "replace") if raw else "", [], 0
        while len(text) - at > PIECE and (cut := BETWEEN_WORDS.search(text, at + PIECE)):
            parts.append(array(self.code, self.encode(text[at : cut.start()])))
            at = cut.start()
        parts.append(array(self.code, [*self.encode(text[at:]), self.end]))
        if sys.byteorder != "little":
            for part in parts:
                part.byteswap()
        return b"".join(parts)


def id_type(ranks: dict[bytes, int]):
    return np.dtype("<u2") if len(ranks) < 1 << 16 else np.dtype("<u4")


def _tokens(shared, length: int):
    """(doc_id, text) -> a row (doc_id, task, at = first id, n) for each text and a row (task, at = number, ids) for each sequence."""

    def run(batches):
        from pyspark import TaskContext

        encoder, task = Encoder(*shared.value), TaskContext.get().partitionId()
        size = encoder.kind.itemsize
        stride, rest, at, done, kind = length * size, b"", 0, 0, None

        def sequences(payload: bytes):
            nonlocal done
            k = len(payload) // stride
            rows = [pa.nulls(k, kind), pa.array(np.full(k, task, np.int64)), pa.array(done + np.arange(k)), pa.nulls(k, pa.int64()), pa.array([payload[i * stride : (i + 1) * stride] for i in range(k)], pa.binary())]
            done += k
            return pa.RecordBatch.from_arrays(rows, names=["doc_id", "task", "at", "n", "ids"])

        for b in batches:
            kind = b.column(0).type
            for first, some in text_slices(b.column(1)):
                ids = list(map(encoder.text, some))
                n = np.array([len(x) // size for x in ids], np.int64)
                ends = at + np.cumsum(n)
                at = int(ends[-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(np.full(len(n), task, np.int64)), pa.array(ends - n), pa.array(n), pa.nulls(len(n), pa.binary())], names=["doc_id", "task", "at", "n", "ids"])
                data = b"".join([rest, *ids])
                whole = len(data) // stride * stride
                rest = data[whole:]
                for k in range(0, whole, 512 * stride):
                    yield sequences(data[k : min(k + 512 * stride, whole)])
        if rest:
            yield sequences(rest + np.full((stride - len(rest)) // size, encoder.end, encoder.kind).tobytes())

    return run


def tokenise(docs: DataFrame, path: str, vocabulary=None, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the tokens of docs under path once; returns (doc_id, task, start, n), one row per row of docs, and (task, number, ids), one row per sequence."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or public_vocabulary())
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = rows.mapInArrow(_tokens(shared, length), f"doc_id {dict(rows.dtypes)['doc_id']}, task long, at long, n long, ids binary")
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVEL)).parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    return stored.where("n is not null").select("doc_id", "task", F.col("at").alias("start"), "n"), stored.where("n is null").select("task", F.col("at").alias("number"), "ids")


def task_numbers(placed: DataFrame, length: int = LENGTH) -> tuple[dict[int, tuple[int, int]], int]:
    """task -> (number of its first sequence, sequences), and all sequences. One row per task."""
    tasks = placed.groupBy("task").agg(F.ceil(F.sum("n") / length).alias("k")).orderBy("task").collect()
    numbers, total = {}, 0
    for r in tasks:
        numbers[r["task"]] = (total, r["k"])
        total += r["k"]
    return numbers, total


def write_shards(
    sequences: DataFrame, path: str, numbers: dict[int, tuple[int, int]], total: int, stride: int, per_shard: int = PER_SHARD, key: int = KEY,
) -> None:
    """Write sequences (task, number, ids) of ``stride`` bytes to their slots under path. Shard k is the file part-<k>."""
    if not total:
        return
    plan = sequences.sparkSession.sparkContext.broadcast(numbers)

    def place(batches):
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for b in batches:
            first = np.array([plan.value[t][0] for t in b.column(0).to_pylist()], np.int64)
            slots = permute(first + b.column(1).to_numpy(), total, key) if b.num_rows else first
            packed = [codec.compress(x, asbytes=True) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(packed, pa.binary())], names=["slot", "packed"])

    def unpack(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            for k in range(0, b.num_rows, 512):
                some = b.column(0).slice(k, 512).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([codec.decompress(x, stride, asbytes=True) for x in some], pa.binary())], names=["ids"])

    placed = sequences.select("task", "number", "ids").mapInArrow(place, "slot long, packed binary")
    shards = -(-total // per_shard)
    dealt = placed.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    lines = dealt.select("packed").mapInArrow(unpack, "ids binary").select(F.col("ids").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").option("compression", "none").text(path)


def shard_files(spark, path: str) -> DataFrame:
    """(shard, path, content): one row per shard; a shard has a fixed largest size. Its number is in the file's name;
    folders above may have any name. Files that are not numbered 0 to n - 1, each once, are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "path", "content")
    n, numbers, last = found.agg(F.count("*"), F.count_distinct("shard"), F.coalesce(F.max("shard"), F.lit(-1))).first()
    if not n == numbers == last + 1:
        raise ValueError(f"{path} holds {n} shards with {numbers} numbers up to {last}")
    return found


def read_slots(spark, path: str, first: int = 0, kind=np.dtype("<u2"), length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, ids) from slot ``first`` on: earlier shards are not opened, earlier records not cut out."""
    stride = length * kind.itemsize + 1

    def run(batches):
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                skip = max(0, first - shard * per_shard)
                for k in range(skip, len(content) // stride, 512):
                    at = range(k, min(k + 512, len(content) // stride))
                    yield pa.RecordBatch.from_arrays([pa.array([shard * per_shard + i for i in at], pa.int64()), pa.array([content[i * stride : (i + 1) * stride - 1] for i in at], pa.binary())], names=["slot", "ids"])

    files = shard_files(spark, path).where(F.col("shard") >= first // per_shard).select("shard", "content")
    return files.mapInArrow(run, "slot long, ids binary")


def documents_by_slot(placed: DataFrame, numbers: dict[int, tuple[int, int]], total: int, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(slot, doc_ids, n_tokens): the documents whose ids a sequence holds, and how many ids are theirs.

    A sequence holds at most as many documents as ids, since each document has at least one.
    """
    plan = placed.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        for b in batches:
            task, start, n = (b.column(i).to_numpy() for i in (1, 2, 3))
            lo, hi = start // length, (start + n - 1) // length
            k = hi - lo + 1
            row = np.repeat(np.arange(len(n)), k)
            local = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
            here = np.minimum((local + 1) * length, (start + n)[row]) - np.maximum(local * length, start[row])
            first = np.array([plan.value[t][0] for t in task.tolist()], np.int64)
            slots = permute(first[row] + local, total, key) if len(row) else local
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(slots), pa.array(here)], names=["doc_id", "slot", "here"])

    kind = dict(placed.dtypes)["doc_id"]
    pieces = placed.mapInArrow(run, f"doc_id {kind}, slot long, here long")
    return pieces.groupBy("slot").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.sum("here").alias("n_tokens"))


def training_order(docs: DataFrame, path: str | None = None, vocabulary=None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write the shards and return one row per sequence as read back from them: slot, shard, record,
    n_tokens (ids that belong to documents), doc_ids, ids_sha256."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_vocabulary()
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    texts, sequences = tokenise(docs, folder, vocabulary, length)
    placed = checkpointed(texts)
    numbers, total = task_numbers(placed, length)
    write_shards(sequences, path, numbers, total, length * id_type(vocabulary[0]).itemsize, per_shard, key)
    discard(spark, folder)
    kind = dict(placed.dtypes)["doc_id"]
    if not total:
        return spark.createDataFrame([], f"slot long, shard long, record long, n_tokens long, doc_ids array<{kind}>, ids_sha256 string")
    found = read_slots(spark, path, 0, id_type(vocabulary[0]), length, per_shard).select("slot", F.sha2("ids", 256).alias("ids_sha256"))
    listed = documents_by_slot(placed, numbers, total, length, key)
    return found.join(listed, "slot").select(
        "slot", F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard).alias("record"), "n_tokens", "doc_ids", "ids_sha256")

"""TIFF layers as a Spark data source: one scan for any number of files, and a writer of one file a layer.

``read_layers`` reads the directories of all files in a job, numbers their bands through, and gives one scan whose
partitions are runs of strips or tiles of about ``PART`` decoded bytes: many small files share a partition, a
large one is split. Ranges of layers, rows and columns are pruned before anything is read; where the session has
filter pushdown for Python sources on, conditions on t, row and col prune in the same way. Decoding is
numpy: no compression, deflate, LZW and PackBits; predictors 1 to 3; strips and tiles; bands interleaved or apart; classic and
big files of either byte order.

Stores that only Spark opens are read as binary files, one task a file.
"""

from __future__ import annotations

import io
import json
import struct
import tempfile
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridloom.sources.files import Staged, opened, readable

# Fixed values of the format: tags, sizes of field types, codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, NODATA = 317, 322, 323, 324, 325, 339, 42113
FIELDS = {1: "u1", 2: "u1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "u", 2: "i", 3: "f"}

PART = 64 << 20
ROWS = 262_144  # rows of a batch
NAME = "tiff_layers"
SCHEMA = "t int, row int, col int, value double"
RANGES = ("t", "row", "col")


@dataclass(frozen=True)
class Page:
    """One image of a file: its shape, how its samples are stored, and where its chunks (strips or tiles) are."""

    width: int
    height: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    apart: bool
    chunk: tuple[int, int]
    tiled: bool
    nodata: float | None
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.chunk[0])

    def place(self, k: int) -> tuple[int, int, int]:
        """(first row, first column, first band) of chunk k."""
        band, at = divmod(k, self.across * self.down) if self.apart else (0, k)
        return at // self.across * self.chunk[0], at % self.across * self.chunk[1], band


def pages(f) -> list[Page]:
    """The images of a file, from its directories."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or len(head) < 8:
        raise ValueError("no TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("no TIFF file")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
        raw = f.read(n * entry + word)
        tags = {}
        for k in range(n):
            tag, kind, size = struct.unpack(order + ("HHQ" if big else "HHI"), raw[k * entry : (k + 1) * entry - word])
            if kind not in FIELDS:
                continue
            dtype = np.dtype(order + FIELDS[kind])
            value = raw[(k + 1) * entry - word : (k + 1) * entry]
            if size * dtype.itemsize > word:
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(size * dtype.itemsize)
            tags[tag] = np.frombuffer(value[: size * dtype.itemsize], dtype)
        out.append(_page(tags, order))
        at = struct.unpack(order + ("Q" if big else "I"), raw[n * entry :])[0]
    return out


def _page(tags: dict[int, np.ndarray], order: str) -> Page:
    one = lambda tag, default: int(tags[tag][0]) if tag in tags else default
    width, height, bits = one(WIDTH, 0), one(HEIGHT, 0), set(map(int, tags.get(BITS, [1])))
    kind, predictor, compression = KINDS.get(one(SAMPLE_FORMAT, 1)), one(PREDICTOR, 1), one(COMPRESSION, NONE)
    if len(bits) != 1 or (size := bits.pop()) not in (8, 16, 32, 64) or not kind or (kind == "f" and size < 32):
        raise ValueError("samples of 8 to 64 bits, all alike, are read")
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {compression} with predictor {predictor} is not read")
    tiled = TILE_OFFSETS in tags
    chunk = (one(TILE_HEIGHT, height), one(TILE_WIDTH, width)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    nodata = None
    if NODATA in tags:
        try:
            nodata = float(tags[NODATA].tobytes().split(b"\0")[0])
        except ValueError:
            pass
    places = [tuple(map(int, tags[t])) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (OFFSETS, COUNTS))]
    return Page(width, height, one(SAMPLES, 1), f"{order}{kind}{size // 8}", compression, predictor, one(PLANAR, 1) == 2, chunk, tiled, nodata, *places)


def unpack_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, bits, held, width = list(base), [], b"", 0, 0, 9
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = list(base), b"", 9
            continue
        if code < len(table):
            now = table[code]
        elif last and code == len(table):
            now = last + last[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def unpack_bits(raw: bytes) -> bytes:
    """PackBits: runs of a byte and of literal bytes."""
    out, k = [], 0
    while k < len(raw):
        n = raw[k] - 256 if raw[k] > 127 else raw[k]
        if n >= 0:
            out.append(raw[k + 1 : k + 2 + n])
            k += 2 + n
        else:
            if n != -128:
                out.append(raw[k + 1 : k + 2] * (1 - n))
            k += 2 if n != -128 else 1
    return b"".join(out)


def decoded(raw: bytes, page: Page, k: int) -> np.ndarray:
    """Chunk k as rows x columns x bands, cut to the image."""
    row, col, _ = page.place(k)
    rows = page.chunk[0] if page.tiled else min(page.chunk[0], page.height - row)
    bands, dtype = 1 if page.apart else page.samples, np.dtype(page.dtype)
    shape = (rows, page.chunk[1], bands)
    size = rows * page.chunk[1] * bands * dtype.itemsize
    if page.compression == LZW:
        raw = unpack_lzw(raw)
    elif page.compression == PACKBITS:
        raw = unpack_bits(raw)
    elif page.compression != NONE:
        raw = zlib.decompress(raw)
    if len(raw) < size:
        raise ValueError("a strip or tile is too short")
    if page.predictor == 3:  # bytes of a row lie in planes, highest first, and are differences
        planes = np.frombuffer(raw[:size], np.uint8).reshape(rows, -1, bands).cumsum(1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
        x = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    else:
        x = np.frombuffer(raw[:size], dtype).reshape(shape)
        if page.predictor == 2:
            whole = x.astype(f"=u{dtype.itemsize}" if dtype.kind != "f" else dtype.newbyteorder("="), copy=False) if dtype.kind != "f" else x.view(f"{page.dtype[0]}u{dtype.itemsize}").astype(f"=u{dtype.itemsize}")
            x = whole.cumsum(1, dtype=f"u{dtype.itemsize}").astype(f"=u{dtype.itemsize}").view(dtype.newbyteorder("="))
    return x[: page.height - row, : page.width - col]


def batches_of(f, page: Page, chunks: Sequence[int], first_t: int, ranges: dict[str, tuple[int, int]]):
    """Record batches (t, row, col, value) of a page's chunks; rows and columns count from 1, missing values are null."""
    lo, hi = (np.array([ranges[c][i] for c in RANGES]) for i in (0, 1))
    for k in chunks:
        row, col, band = page.place(k)
        bands = 1 if page.apart else page.samples
        end = (first_t + band + bands - 1, min(row + page.chunk[0], page.height), min(col + page.chunk[1], page.width))
        if (np.array(end) < lo).any() or (np.array([first_t + band, row + 1, col + 1]) > hi).any():
            continue
        f.seek(page.offsets[k])
        x = decoded(f.read(page.counts[k]), page, k)
        r0, c0 = max(lo[1] - 1 - row, 0), max(lo[2] - 1 - col, 0)
        x = x[r0 : max(hi[1] - row, 0), c0 : max(hi[2] - col, 0)]
        for b in range(bands):
            t = first_t + band + b
            if not lo[0] <= t <= hi[0] or not x[:, :, b].size:
                continue
            value = x[:, :, b].astype(np.float64)
            none = np.isnan(value) | (False if page.nodata is None else value == page.nodata)
            for i in range(0, len(value), max(1, ROWS // value.shape[1])):
                part, gone = value[i : i + max(1, ROWS // value.shape[1])], none[i : i + max(1, ROWS // value.shape[1])]
                n, m = part.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * m, t, np.int32)), pa.array(np.repeat(np.arange(n, dtype=np.int32) + np.int32(row + r0 + i + 1), m)), pa.array(np.tile(np.arange(m, dtype=np.int32) + np.int32(col + c0 + 1), n)),
                     pa.array(part.ravel(), mask=gone.ravel())], names=["t", "row", "col", "value"])


@dataclass
class Share(InputPartition):
    """Runs of chunks: (path, page, first chunk, end, first layer)."""

    runs: list[tuple[str, int, int, int, int]]


class LayerReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.part = int(options.get("part", PART))
        self.ranges = {c: tuple(json.loads(options.get(f"range_{c}", "[1, 2147483647]"))) for c in RANGES}

    def partitions(self):
        """Files: [path, first layer, [[chunks, bytes of a chunk, layers], ...] by page]. Opens nothing."""
        out, runs, size = [], [], 0
        for path, t, found in self.files:
            for page, (chunks, each, layers) in enumerate(found):
                if t <= self.ranges["t"][1] and t + layers > self.ranges["t"][0]:
                    k = 0
                    while k < chunks:
                        stop = min(chunks, k + max(1, (self.part - size) // max(each, 1)))
                        runs.append((path, page, k, stop, t))
                        size, k = size + (stop - k) * each, stop
                        if size >= self.part:
                            out.append(Share(runs))
                            runs, size = [], 0
                t += layers
        return out + [Share(runs)] if runs or not out else out

    def read(self, partition: Share):
        path, f, found = None, None, []
        for where, page, k, stop, t in partition.runs:
            if where != path:
                if f:
                    f.close()
                path, f = where, opened(where)
                found = pages(f)
            yield from batches_of(f, found[page], range(k, stop), t, self.ranges)
        if f:
            f.close()


class PruningReader(LayerReader):
    def pushFilters(self, filters):
        """Bounds of t, row and col by numbers cut the ranges; all other conditions stay with Spark."""
        for x in filters:
            name = x.attribute[0] if getattr(x, "attribute", None) else None
            value = getattr(x, "value", None)
            if len(getattr(x, "attribute", ())) != 1 or name not in RANGES or not isinstance(value, int):
                yield x
                continue
            lo, hi = self.ranges[name]
            match x:
                case EqualTo():
                    lo, hi = max(lo, value), min(hi, value)
                case GreaterThan():
                    lo = max(lo, value + 1)
                case GreaterThanOrEqual():
                    lo = max(lo, value)
                case LessThan():
                    hi = min(hi, value - 1)
                case LessThanOrEqual():
                    hi = min(hi, value)
                case _:
                    yield x
            self.ranges[name] = (lo, hi)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class LayerFile:
    """One layer on its way to a file: cells come row by row, a strip is packed when its last row has passed."""

    def __init__(self, shape: tuple[int, int], dtype: str, compression: int, predictor: int, strip: int):
        self.shape, self.dtype, self.compression, self.predictor, self.strip = shape, np.dtype(dtype), compression, predictor, strip
        self.spool, self.counts = tempfile.SpooledTemporaryFile(32 << 20), []
        self.rows = self._fresh()

    def _fresh(self) -> np.ndarray:
        return np.full((min(self.strip, self.shape[0] - len(self.counts) * self.strip), self.shape[1]), np.nan)

    def _pack(self) -> None:
        x = self.rows.astype(self.dtype)
        if self.predictor == 2:
            whole = x.view(f"u{self.dtype.itemsize}")
            x = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], 1)
        raw = x.astype(x.dtype.newbyteorder("<")).tobytes()
        raw = zlib.compress(raw) if self.compression == DEFLATE else raw
        self.counts.append(len(raw))
        self.spool.write(raw)
        if len(self.counts) * self.strip < self.shape[0]:
            self.rows = self._fresh()

    def add(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        """Cells sorted by row; rows and columns count from 1."""
        if len(row) and (row[0] < 1 or row[-1] > self.shape[0] or col.min() < 1 or col.max() > self.shape[1]):
            raise ValueError("a cell lies outside the layer")
        k = 0
        while k < len(row):
            end = (len(self.counts) + 1) * self.strip
            stop = int(np.searchsorted(row, end, "right"))
            self.rows[row[k:stop] - 1 - (end - self.strip), col[k:stop] - 1] = value[k:stop]
            if stop < len(row):
                self._pack()
            k = stop

    def finish(self, stream) -> None:
        while len(self.counts) * self.strip < self.shape[0]:
            self._pack()
        n, data = len(self.counts), sum(self.counts)
        big = data + 16 * n > 4_000_000_000
        word, entry, head = (8, 20, 16) if big else (4, 12, 8)
        kind = 16 if big else 4
        fields = [
            (WIDTH, 4, [self.shape[1]]), (HEIGHT, 4, [self.shape[0]]), (BITS, 3, [8 * self.dtype.itemsize]), (COMPRESSION, 3, [self.compression]), (PHOTOMETRIC, 3, [1]), (OFFSETS, kind, None), (SAMPLES, 3, [1]),
            (STRIP_ROWS, 4, [self.strip]), (COUNTS, kind, self.counts), (PREDICTOR, 3, [self.predictor]), (SAMPLE_FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[self.dtype.kind]]), (NODATA, 2, list(b"nan\0")),
        ]
        after = head + (8 if big else 2) + entry * len(fields) + word  # arrays follow the directory, strips follow these
        begin = after + (2 * n * word if n > 1 else 0)
        offsets = (begin + np.cumsum([0, *self.counts[:-1]])).tolist()
        stream.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
        stream.write(struct.pack("<Q" if big else "<H", len(fields)))
        long = []
        for tag, k, values in fields:
            raw = np.array(offsets if values is None else values, "<" + FIELDS[k]).tobytes()
            if len(raw) > word:
                long.append(raw)
                where = after + sum(map(len, long[:-1]))
                value = struct.pack("<Q" if big else "<I", where)
            else:
                value = raw.ljust(word, b"\0")
            stream.write(struct.pack("<HHQ" if big else "<HHI", tag, k, len(raw) // np.dtype(FIELDS[k]).itemsize) + value)
        stream.write(b"\0" * word + b"".join(long))
        self.spool.seek(0)
        while some := self.spool.read(1 << 20):
            stream.write(some)
        self.spool.close()


class LayerWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.staged = Staged(options["path"], overwrite)
        self.shape = (int(options["nrow"]), int(options["ncol"]))
        self.name, self.dtype = options.get("name", "layer_{t}.tif"), options.get("dtype", "f8")
        self.compression = {"none": NONE, "deflate": DEFLATE}[options.get("compression", "deflate")]
        self.predictor = int(options.get("predictor", 1))
        self.strip = int(options.get("strip", max(1, (1 << 20) // (8 * self.shape[1]))))

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt, paths, layer, now = f"{context.partitionId()}-{context.taskAttemptId()}", [], None, None

        def close():
            path, stream = self.staged.create(attempt, self.name.format(t=now))
            with stream:
                layer.finish(stream)
            paths.append(path)

        for b in iterator:
            t, row, col = (b.column(c).to_numpy(zero_copy_only=False) for c in RANGES)
            value = b.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
            cut = np.flatnonzero(np.diff(t)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(t)]):
                if lo == hi:
                    continue
                if now != t[lo]:
                    if layer:
                        close()
                    now, layer = int(t[lo]), LayerFile(self.shape, self.dtype, self.compression, self.predictor, self.strip)
                layer.add(row[lo:hi], col[lo:hi], value[lo:hi])
        if layer:
            close()
        return Written(paths)

    def commit(self, messages):
        self.staged.commit([p for m in messages if m for p in m.paths])

    def abort(self, messages):
        self.staged.clear()


class TiffLayers(DataSource):
    """Format ``tiff_layers``; ``read_layers`` and ``write_layers`` set its options."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PruningReader if self.options.get("pushdown") == "true" else LayerReader)(self.options)

    def writer(self, schema, overwrite):
        return LayerWriter(self.options, overwrite)


def summary(f) -> tuple[int, int, list[list[int]]]:
    """(rows, columns, pages as [chunks, bytes of a chunk, layers])."""
    found = pages(f)
    shapes = {(p.height, p.width) for p in found}
    if len(shapes) != 1:
        raise ValueError("the images of a file differ in shape")
    return *shapes.pop(), [[len(p.offsets), p.chunk[0] * p.chunk[1] * np.dtype(p.dtype).itemsize * (1 if p.apart else p.samples), p.samples] for p in found]


def directories(spark: SparkSession, paths: Sequence[str]) -> list[tuple[int, int, list[list[int]]]]:
    """The summary of every file, in their order, from one job over the files."""
    direct = readable(paths[0])

    def run(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            sources = keys if direct else b.column(1).to_pylist()
            out = []
            for x in sources:
                with opened(x) if direct else io.BytesIO(x) as f:
                    out.append(json.dumps(summary(f)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], names=["path", "found"])

    if direct:
        files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    else:
        files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    found = {_plain(r["path"]): json.loads(r["found"]) for r in files.mapInArrow(run, "path string, found string").collect()}  # one row a file
    return [found[_plain(p)] for p in paths]


def _plain(path: str) -> str:
    return path.replace("file:///", "/").replace("file:/", "/")


def read_layers(
    spark: SparkSession, paths: Sequence[str], layers: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, part: int = PART,
) -> tuple[DataFrame, list[int], tuple[int, int]]:
    """((t, row, col, value), layers of each file, (rows, columns)): the bands of the files, in their order, are the layers 1, 2, ...

    Files must agree in shape. The ranges (first, last) restrict what is read.
    """
    found = directories(spark, paths)
    shapes = {(n, m) for n, m, _ in found}
    if len(shapes) != 1:
        raise ValueError(f"layers differ in shape: {sorted(shapes)[:2]}")
    bands, files, t = [], [], 1
    for path, (_, _, pages_) in zip(paths, found):
        bands.append(sum(x[2] for x in pages_))
        files.append([path, t, pages_])
        t += bands[-1]
    wanted = {c: list(r) for c, r in zip(RANGES, (layers, rows, cols)) if r}
    if not readable(paths[0]):
        return _by_spark(spark, files, wanted), bands, shapes.pop()
    spark.dataSource.register(TiffLayers)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {f"range_{c}": json.dumps(r) for c, r in wanted.items()}
    return spark.read.format(NAME).options(files=json.dumps(files), part=str(part), pushdown=pushdown, **options).load(), bands, shapes.pop()


def _by_spark(spark: SparkSession, files: list, wanted: dict[str, list[int]]) -> DataFrame:
    """The same rows through Spark's binary files, for stores that Python does not open."""
    first, ranges = {_plain(p): t for p, t, _ in files}, {c: tuple(wanted.get(c, (1, 2**31 - 1))) for c in RANGES}

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f, t = io.BytesIO(content), first[_plain(path)]
                for page in pages(f):
                    yield from batches_of(f, page, range(len(page.offsets)), t, ranges)
                    t += page.samples

    return spark.read.format("binaryFile").load([p for p, *_ in files]).select("path", "content").mapInArrow(run, SCHEMA)


def write_layers(long: DataFrame, path: str, nrow: int, ncol: int, name: str = "layer_{t}.tif", mode: str = "append", **options: str) -> None:
    """Layers of long rows (t, row, col, value) as one file each below path; cells without a row are missing.

    Options: dtype (f8, f4, i4, ...), compression (deflate, none), predictor (1, 2), strip (rows). A layer is written by one
    task, strip by strip.
    """
    spark = long.sparkSession
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is append or overwrite")
    if (twice := long.groupBy("t", "row", "col").count().where("count > 1").limit(1).collect()):
        raise ValueError(f"a cell is given twice: {twice[0].asDict()}")
    spark.dataSource.register(TiffLayers)
    rows = long.select(*(F.col(c).cast("int").alias(c) for c in RANGES), F.col("value").cast("double").alias("value")).where("value is not null")
    rows = rows.repartition("t").sortWithinPartitions("t", "row", "col")
    rows.write.format(NAME).options(nrow=str(nrow), ncol=str(ncol), name=name, **options).mode(mode).save(path)

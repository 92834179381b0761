"""NetCDF classic cubes (CDF-1, CDF-2, CDF-5) as a Spark data source: read by byte ranges, written in files of records.

A cube is a variable of three dimensions: time, rows, columns. Its file is read in runs of records, and of rows where a
record is large, about ``PART`` bytes each; ranges of layers and rows are pruned first. Fill values become null,
packed values are unpacked, and rows run from the top: a row coordinate that increases is turned over. Layers are numbered by time,
across files; missing and repeated times are refused. Times in CF units (``days since 2000-01-01``) become timestamps.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from gridloom.sources.files import Staged, opened
from gridloom.sources.tiff import Written

# Fixed values of the format: types by number, list tags.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
CHAR, FLOAT, DOUBLE = 2, 5, 6
SECONDS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}
REAL, NO_LEAP = ("standard", "gregorian", "proleptic_gregorian"), ("noleap", "365_day")

PART = 64 << 20
ROWS = 262_144
NAME = "netcdf_cube"
SCHEMA = "t int, row int, col int, value double"


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: str
    begin: int
    record: bool = False
    step: int = 0  # bytes from a record to the next, or of a slab


@dataclass
class Header:
    records: int
    dims: list[tuple[str, int]] = field(default_factory=list)
    variables: dict[str, Variable] = field(default_factory=dict)

    def size(self, dim: int) -> int:
        return self.dims[dim][1] or self.records


def header(f) -> Header:
    """A file's dimensions and variables, from its first bytes."""
    f.seek(0)
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no NetCDF classic file")
    version = magic[3]
    count, place = (">q", 8) if version == 5 else (">i", 4), ">i" if version == 1 else ">q"
    number = lambda fmt: struct.unpack(fmt, f.read(struct.calcsize(fmt)))[0]
    size = lambda: number(count[0])

    def text() -> str:
        n = size()
        return f.read(n + -n % 4)[:n].decode()

    def listed(tag: int, one) -> list:
        found, n = number(">i"), size()
        if found not in (0, tag):
            raise ValueError("damaged NetCDF header")
        return [one() for _ in range(n)]

    def attribute():
        name, kind, n = text(), number(">i"), size()
        dtype = np.dtype(TYPES[kind])
        raw = f.read(n * dtype.itemsize + -(n * dtype.itemsize) % 4)[: n * dtype.itemsize]
        return name, raw.decode("utf-8", "replace").rstrip("\0") if kind == CHAR else np.frombuffer(raw, dtype)

    out = Header(size())
    out.dims = listed(DIMENSIONS, lambda: (text(), size()))
    listed(ATTRIBUTES, attribute)

    def variable() -> Variable:
        name = text()
        dims = [size() for _ in range(size())]
        attributes, kind = dict(listed(ATTRIBUTES, attribute)), TYPES[number(">i")]
        size()  # the stored size overflows for large variables; shapes tell it
        return Variable(name, dims, attributes, kind, number(place))

    for v in listed(VARIABLES, variable):
        out.variables[v.name] = v
        v.record = bool(v.dims) and out.dims[v.dims[0]][1] == 0
        v.step = int(np.prod([out.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize
    records = [v for v in out.variables.values() if v.record]
    if len(records) > 1 or (records and np.dtype(records[0].kind).itemsize >= 4):
        step = sum(v.step + -v.step % 4 for v in records)
    else:
        step = sum(v.step for v in records)  # a lone variable of small numbers is not padded
    for v in records:
        v.step = step
    if out.records < 0 and records:  # written as a stream: the file's size tells
        out.records = (f.seek(0, 2) or f.tell()) - min(v.begin for v in records)
        out.records //= step
    return out


def values(f, head: Header, v: Variable) -> np.ndarray:
    """All values of a variable of one dimension."""
    n, dtype = head.size(v.dims[0]), np.dtype(v.kind)
    if not v.record:
        f.seek(v.begin)
        return np.frombuffer(f.read(n * dtype.itemsize), dtype)
    out = []
    for k in range(n):
        f.seek(v.begin + k * v.step)
        out.append(f.read(dtype.itemsize))
    return np.frombuffer(b"".join(out), dtype)


def cf_times(numbers: np.ndarray, units: str | None, calendar: str | None) -> list:
    """Timestamps of CF time values, or the numbers themselves where no units are given."""
    if not np.isfinite(numbers.astype(float)).all():
        raise ValueError("every layer needs a time")
    if not units:
        return numbers.astype(float).tolist()
    found = re.fullmatch(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+)(?:\.\d*)?)?)?\s*(?:Z|UTC|[+-]0+:?0*)?\s*", units, re.I)
    calendar = (calendar or "standard").lower()
    if not found or calendar not in REAL + NO_LEAP:
        raise ValueError(f"time units are not read: {units}, {calendar}")
    step = SECONDS[found[1].lower()]
    first = datetime(*(int(x or 0) for x in found.groups()[1:]))
    seconds = (numbers.astype(float) * step).round(3).tolist()
    if calendar in REAL:
        return [first + timedelta(seconds=s) for s in seconds]
    out = []
    for s in seconds:  # years of 365 days
        days, rest = divmod((datetime(2001, first.month, min(first.day, 28 if first.month == 2 else 31)) - datetime(2001, 1, 1)).days * 86_400 + first.hour * 3_600 + first.minute * 60 + first.second + s, 86_400)
        years, day = divmod(int(days), 365)
        moment = datetime(2001, 1, 1) + timedelta(days=day, seconds=rest)
        out.append(moment.replace(year=first.year + years))
    return out


def cube_of(head: Header, var: str | None) -> Variable:
    """The chosen cube, or the only one."""
    cubes = {n: v for n, v in head.variables.items() if len(v.dims) == 3}
    if var is None and len(cubes) > 1:
        raise ValueError(f"several variables, choose one: {', '.join(cubes)}")
    if var is not None and var not in cubes or not cubes:
        raise ValueError(f"no variable {var}" if var else "no variable of time, rows and columns")
    return cubes[var] if var else next(iter(cubes.values()))


@dataclass
class Share(InputPartition):
    """(path, first record, end, first row, end): runs of records, or of the rows of one."""

    runs: list[tuple[str, int, int, int, int]]


class CubeReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])  # [path, layer numbers of its records]
        self.var, self.part = options["var"], int(options.get("part", PART))
        self.shape, self.size = json.loads(options["shape"]), int(options["size"])
        self.layers, self.rows = (json.loads(options.get(k, "[1, 2147483647]")) for k in ("layers", "rows"))

    def partitions(self):
        out, runs, held = [], [], 0
        nrow, ncol = self.shape
        per_row = ncol * self.size
        lines = max(1, min(nrow, self.part // max(1, per_row)))
        for path, numbers in self.files:
            wanted = [k for k, t in enumerate(numbers) if self.layers[0] <= t <= self.layers[1]]
            for k in wanted:
                for row in range(0, nrow, lines):
                    stop = min(row + lines, nrow)
                    if runs and runs[-1][0] == path and runs[-1][2] == k and (runs[-1][3:], row, stop) == ((0, nrow), 0, nrow):
                        runs[-1] = (path, runs[-1][1], k + 1, 0, nrow)
                    else:
                        runs.append((path, k, k + 1, row, stop))
                    held += (stop - row) * per_row
                    if held >= self.part:
                        out.append(Share(runs))
                        runs, held = [], 0
        return out + [Share(runs)] if runs or not out else out

    def read(self, partition: Share):
        numbers, (nrow, ncol) = dict(self.files), self.shape
        for path, first, end, row, stop in partition.runs:
            with opened(path) as f:
                head = header(f)
                v = head.variables[self.var]
                dtype, turned = np.dtype(v.kind), _turned(f, head, v)
                scale, offset = (float(v.attributes[a][0]) if a in v.attributes else d for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
                gone = [float(x) for a in ("_FillValue", "missing_value") if a in v.attributes and not isinstance(v.attributes[a], str) for x in v.attributes[a]]
                for k in range(first, end):
                    for at in range(row, stop, max(1, ROWS // ncol)):
                        n = min(max(1, ROWS // ncol), stop - at)
                        lines = np.arange(at, at + n)
                        lines = nrow - lines if turned else lines + 1
                        if lines.max() < self.rows[0] or lines.min() > self.rows[1]:
                            continue
                        f.seek(v.begin + k * v.step + at * ncol * dtype.itemsize)
                        raw = np.frombuffer(f.read(n * ncol * dtype.itemsize), dtype).astype(np.float64).reshape(n, ncol)
                        pick = (lines >= self.rows[0]) & (lines <= self.rows[1])
                        raw, lines = raw[pick], lines[pick]
                        none = np.isnan(raw) | np.isin(raw, gone)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(raw.size, numbers[path][k], np.int32)), pa.array(np.repeat(lines, ncol).astype(np.int32)), pa.array(np.tile(np.arange(1, ncol + 1, dtype=np.int32), len(raw))),
                             pa.array((raw * scale + offset).ravel(), mask=none.ravel())], names=["t", "row", "col", "value"])


def _turned(f, head: Header, v: Variable) -> bool:
    """Whether rows run from the bottom: their coordinate increases."""
    coordinate = head.variables.get(head.dims[v.dims[1]][0])
    if coordinate is None or coordinate.dims != [v.dims[1]]:
        return False
    y = values(f, head, coordinate).astype(float)
    return len(y) > 1 and bool(y[-1] > y[0])


class CubeWriter(DataSourceArrowWriter):
    """Files of whole records: time as double, then one slab. The header comes first, so a file is written as a stream."""

    def __init__(self, options, overwrite: bool):
        self.staged = Staged(options["path"], overwrite)
        self.shape, self.times = (int(options["nrow"]), int(options["ncol"])), json.loads(options["times"])
        self.per_file, self.var, self.units, self.dtype = int(options["per_file"]), options["var"], options["units"], options["dtype"]

    def head(self, n: int) -> bytes:
        size = np.dtype(self.dtype).itemsize * self.shape[0] * self.shape[1]
        wide = size >= 2**31 - 4
        word = ">q" if wide else ">i"
        text = lambda s: struct.pack(word, len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
        chars = lambda name, s: text(name) + struct.pack(">i", CHAR) + text(s)
        tag = lambda t, k: struct.pack(">i", t if k else 0) + struct.pack(word, k)
        dims = tag(DIMENSIONS, 3) + text("time") + struct.pack(word, 0) + text("row") + struct.pack(word, self.shape[0]) + text("col") + struct.pack(word, self.shape[1])
        index = lambda *d: struct.pack(word, len(d)) + b"".join(struct.pack(word, x) for x in d)
        kind = DOUBLE if self.dtype == "f8" else FLOAT
        fill = text("_FillValue") + struct.pack(">i", kind) + struct.pack(word, 1) + np.array([np.nan], f">{self.dtype}").tobytes()
        times = text("time") + index(0) + tag(ATTRIBUTES, 1 if self.units else 0) + (chars("units", self.units) if self.units else b"") + struct.pack(">i", DOUBLE) + struct.pack(word, 8)
        slab = text(self.var) + index(0, 1, 2) + tag(ATTRIBUTES, 1) + fill + struct.pack(">i", kind) + struct.pack(word, size + -size % 4)
        front = b"CDF" + bytes([5 if wide else 2]) + struct.pack(word, n) + dims + tag(ATTRIBUTES, 0) + tag(VARIABLES, 2)
        begin = len(front) + len(times) + 8 + len(slab) + 8
        return front + times + struct.pack(">q", begin) + slab + struct.pack(">q", begin + 8)

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt, paths, made = f"{context.partitionId()}-{context.taskAttemptId()}", [], None
        for b in iterator:
            t, row, col, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "row", "col", "value"))
            cut = np.flatnonzero(np.diff(t)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(t)]):
                if lo == hi:
                    continue
                number = (int(t[lo]) - 1) // self.per_file
                if made is None or made.number != number:
                    if made:
                        made.close()
                    made = CubeFile(self, number, *self.staged.create(attempt, f"cube-{number:06d}.nc"))
                    paths.append(made.path)
                made.add(int(t[lo]), row[lo:hi], col[lo:hi], value[lo:hi])
        if made:
            made.close()
        return Written(paths)

    def commit(self, messages):
        self.staged.commit([p for m in messages if m for p in m.paths])

    def abort(self, messages):
        self.staged.clear()


class CubeFile:
    """One file on its way: cells come by layer and row; rows go out as soon as they have passed."""

    def __init__(self, writer: CubeWriter, number: int, path: str, stream):
        self.number, self.path, self.stream, self.writer = number, path, stream, writer
        self.first = number * writer.per_file + 1
        self.last = min(self.first + writer.per_file - 1, len(writer.times))
        stream.write(writer.head(self.last - self.first + 1))
        self.t, self.row, self.line = self.first, 0, None

    def _out(self, t: int, row: int) -> None:
        """Write all rows before (t, row)."""
        nrow, ncol = self.writer.shape
        while (self.t, self.row) < (t, row):
            if self.row == 0:
                self.stream.write(struct.pack(">d", self.writer.times[self.t - 1]))
                self.row = 1
                continue
            line = np.full(ncol, np.nan) if self.line is None else self.line
            self.stream.write(line.astype(f">{self.writer.dtype}").tobytes())
            self.line = None
            self.t, self.row = (self.t, self.row + 1) if self.row < nrow else (self._padded(), 0)

    def _padded(self) -> int:
        size = np.dtype(self.writer.dtype).itemsize * self.writer.shape[0] * self.writer.shape[1]
        self.stream.write(b"\0" * (-size % 4))
        return self.t + 1

    def add(self, t: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        nrow, ncol = self.writer.shape
        if not self.first <= t <= self.last:
            raise ValueError("a cell lies outside the cube")
        cut = np.flatnonzero(np.diff(row)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(row)]):
            if row[lo] == 0:  # keeps a file where no cell has a value
                continue
            if not 1 <= row[lo] <= nrow or col[lo:hi].min() < 1 or col[lo:hi].max() > ncol:
                raise ValueError("a cell lies outside the cube")
            self._out(t, int(row[lo]))
            if self.line is None:
                self.line = np.full(ncol, np.nan)
            self.line[col[lo:hi] - 1] = value[lo:hi]

    def close(self) -> None:
        self._out(self.last + 1, 0)
        self.stream.close()


class NetcdfCube(DataSource):
    """Format ``netcdf_cube``; ``read_cube`` and ``write_cube`` set its options."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CubeReader(self.options)

    def writer(self, schema, overwrite):
        return CubeWriter(self.options, overwrite)


def read_cube(
    spark: SparkSession, paths: str | Sequence[str], var: str | None = None, layers: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, part: int = PART,
) -> tuple[DataFrame, list, tuple[int, int]]:
    """((t, row, col, value), the layers' times, (rows, columns)) of one cube, in one file or in several by time."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found, times = [], []
    for path in paths:
        with opened(path) as f:
            head = header(f)
            v = cube_of(head, var)
            axis = head.variables.get(head.dims[v.dims[0]][0])
            if axis is None or axis.dims != v.dims[:1]:
                raise ValueError(f"{path} has no times, so the order of its layers cannot be verified")
            units, calendar = (axis.attributes.get(a) for a in ("units", "calendar"))
            numbers = values(f, head, axis)
            gone = [x for a in ("_FillValue", "missing_value") if a in axis.attributes for x in axis.attributes[a]]
            numbers = np.where(np.isin(numbers, gone), np.nan, numbers) if gone else numbers
            found.append((path, v.name, (head.size(v.dims[1]), head.size(v.dims[2])), np.dtype(v.kind).itemsize, len(numbers)))
            times += cf_times(numbers, units, calendar)
    if len({x[1:4] for x in found}) != 1:
        raise ValueError("the files hold cubes of different names, shapes or types")
    if not times:
        raise ValueError("the cube has no layers")
    if len(set(map(str, times))) != len(times):
        raise ValueError("a time is given twice")
    rank = {i: k + 1 for k, i in enumerate(sorted(range(len(times)), key=times.__getitem__))}
    files, at = [], 0
    for path, *_, n in found:
        files.append([path, [rank[at + k] for k in range(n)]])
        at += n
    _, name, shape, size, _ = found[0]
    spark.dataSource.register(NetcdfCube)
    ranges = {k: json.dumps(list(r)) for k, r in (("layers", layers), ("rows", rows)) if r}
    options = {"files": json.dumps(files), "var": name, "shape": json.dumps(list(shape)), "size": str(size), "part": str(part)}
    return spark.read.format(NAME).options(**options, **ranges).load(), sorted(times), shape


def write_cube(
    long: DataFrame, path: str, nrow: int, ncol: int, times: Sequence[float], var: str = "value", units: str = "", dtype: str = "f8", per_file: int | None = None, mode: str = "append",
) -> None:
    """Long rows (t, row, col, value) as a cube of len(times) layers, ``per_file`` of them a file (all in one by default)."""
    spark = long.sparkSession
    if dtype not in ("f4", "f8") or mode not in ("append", "overwrite"):
        raise ValueError("dtype is f4 or f8, mode is append or overwrite")
    if (twice := long.groupBy("t", "row", "col").count().where("count > 1").limit(1).collect()):
        raise ValueError(f"a cell is given twice: {twice[0].asDict()}")
    per_file = per_file or len(times)
    spark.dataSource.register(NetcdfCube)
    rows = long.select(*(F.col(c).cast("int").alias(c) for c in ("t", "row", "col")), F.col("value").cast("double").alias("value")).where("value is not null")
    files = -(-len(times) // per_file)
    each = spark.range(files).select((F.col("id") * per_file + 1).cast("int").alias("t"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(None).cast("double").alias("value"))
    rows = rows.unionByName(each).withColumn("file", F.floor((F.col("t") - 1) / per_file)).repartition("file").sortWithinPartitions("t", "row", "col").drop("file")
    options = {"nrow": str(nrow), "ncol": str(ncol), "times": json.dumps([float(x) for x in times]), "var": var, "units": units, "dtype": dtype, "per_file": str(per_file)}
    rows.write.format(NAME).options(**options).mode(mode).save(path)

"""TIFF layers and NetCDF cubes against files put together by hand, and round trips."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import netcdf, readers, tiff


def by_hand(path, image, order="<", compression=1, predictor=1, tile=None, strip=3, apart=False, nodata=None, big=False):
    """A TIFF file of image (rows, columns, bands), written field by field."""
    rows, cols, bands = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]

    def packed(x):
        if predictor == 2:
            y = x.astype(np.int64) if x.dtype.kind != "f" else x.view(f"i{x.dtype.itemsize}").astype(np.int64)
            y = np.concatenate([y[:, :1], np.diff(y, axis=1)], 1)
            raw = y.astype(f"u{x.dtype.itemsize}").astype(f"{order}u{x.dtype.itemsize}").tobytes()
        elif predictor == 3:
            parts = []
            for line in x.astype(x.dtype.newbyteorder(">")):
                planes = np.frombuffer(line.tobytes(), np.uint8).reshape(-1, x.dtype.itemsize).T.reshape(-1, x.shape[2]).astype(np.int64)
                parts.append(np.concatenate([planes[:1], np.diff(planes, axis=0)]).astype(np.uint8).tobytes())
            raw = b"".join(parts)
        else:
            raw = x.astype(x.dtype.newbyteorder(order)).tobytes()
        return {1: lambda r: r, 5: lzw, 8: zlib.compress, 32773: runs}[compression](raw)

    height, width = tile or (strip, cols)
    chunks = []
    for planes in ([image[:, :, b : b + 1] for b in range(bands)] if apart else [image]):
        for r in range(0, rows, height):
            for c in range(0, cols, width):
                part = planes[r : r + height, c : c + width]
                if tile:
                    part = np.pad(part, ((0, height - part.shape[0]), (0, width - part.shape[1]), (0, 0)))
                chunks.append(packed(part))
    fields = {256: (4, [cols]), 257: (4, [rows]), 258: (3, [8 * image.dtype.itemsize] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [kind] * bands)}
    fields |= {322: (4, [width]), 323: (4, [height])} if tile else {278: (4, [height])}
    if nodata is not None:
        fields[42113] = (2, list(str(nodata).encode() + b"\0"))
    word, at, body = (8, 16, b"") if big else (4, 8, b"")
    offsets = []
    for c in chunks:
        offsets.append(at + len(body))
        body += c
    fields[324 if tile else 273], fields[325 if tile else 279] = (16 if big else 4, offsets), (16 if big else 4, [len(c) for c in chunks])
    entries, sizes = b"", {2: 1, 3: 2, 4: 4, 16: 8}
    for tag in sorted(fields):
        kind_, values = fields[tag]
        raw = np.array(values, f"{order}u{sizes[kind_]}").tobytes()
        if len(raw) > word:
            value, body = struct.pack(order + ("Q" if big else "I"), at + len(body)), body + raw
        else:
            value = raw.ljust(word, b"\0")
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind_, len(values)) + value
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at + len(body)) if big else struct.pack(order + "HI", 42, at + len(body)))
    path.write_bytes(head + body + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + b"\0" * word)
    return str(path)


def lzw(raw):
    """Packs by the format's rules: grow the table until code 4,094, then clear it."""
    out, bits, n = [], 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    table, width, now = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    free = 258
    for b in raw:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now], width)
        table[now + bytes([b])] = free
        free += 1
        if free in (512, 1024, 2048):
            width += 1
        if free == 4094:
            put(256, width)
            table, width, free = {bytes([i]): i for i in range(256)}, 9, 258
        now = bytes([b])
    put(table[now], width)
    free += 1
    put(257, width + (free in (512, 1024, 2048)))
    return (bits << (-n % 8)).to_bytes((n + 7) // 8, "big")


def runs(raw):
    out, k = b"", 0
    while k < len(raw):
        j = k
        while j < len(raw) and raw[j] == raw[k] and j - k < 128:
            j += 1
        out += bytes([(1 - (j - k)) % 256, raw[k]]) if j - k > 1 else bytes([0, raw[k]])
        k = j
    return out


RNG = np.random.default_rng(8)
IMAGE = RNG.normal(size=(11, 7, 1))
CASES = {
    "plain": (IMAGE, {}), "motorola": (IMAGE, {"order": ">"}), "deflate": (IMAGE.astype("f4"), {"compression": 8}), "predicted": (RNG.integers(0, 60_000, (11, 7, 1)).astype("u2"), {"compression": 8, "predictor": 2}),
    "signed": (RNG.integers(-100, 100, (11, 7, 2)).astype("i2"), {"predictor": 2, "order": ">"}), "float predictor": (RNG.normal(size=(11, 7, 1)).astype("f4"), {"compression": 8, "predictor": 3}), "tiles": (IMAGE, {"tile": (4, 4), "compression": 8}),
    "bands": (RNG.normal(size=(11, 7, 3)), {"tile": (8, 4)}), "bands apart": (RNG.normal(size=(11, 7, 3)), {"apart": True}), "lzw": (RNG.integers(0, 4, (60, 90, 1)).astype("u1"), {"compression": 5, "strip": 60}),
    "lzw long": (RNG.integers(0, 250, (80, 200, 1)).astype("u1"), {"compression": 5, "strip": 80, "predictor": 2}), "packbits": (RNG.integers(0, 3, (11, 7, 1)).astype("u1"), {"compression": 32773}), "big": (IMAGE, {"big": True}),
    "no data": (np.where(IMAGE > 1, -9999.0, IMAGE), {"nodata": -9999}), "not a number": (np.where(IMAGE > 1, np.nan, IMAGE), {}),
}


@pytest.mark.parametrize("case", CASES)
def test_files_by_hand(tmp_path, case):
    image, how = CASES[case]
    path = by_hand(tmp_path / "x.tif", image, **how)
    with open(path, "rb") as f:
        (page,) = tiff.pages(f)
        got = [b.to_pandas() for b in tiff.batches_of(f, page, range(len(page.offsets)), 4, {c: (1, 10**6) for c in tiff.RANGES})]
    back = np.full(image.shape, np.inf)
    for b in got:
        back[b.row - 1, b.col - 1, b.t - 4] = b.value
    want = image.astype(float)
    assert np.array_equal(back, np.where(want == how.get("nodata", np.inf), np.nan, want), equal_nan=True)


def test_layers_of_many_files_are_one_scan(spark, tmp_path):
    images = [RNG.normal(size=(11, 7, 1 + k % 2)) for k in range(5)]
    paths = [by_hand(tmp_path / f"f{k}.tif", x, tile=(4, 4) if k % 2 else None) for k, x in enumerate(images)]
    want = {(1 + t, r + 1, c + 1): v for t, x in enumerate(x[:, :, b] for x in images for b in range(x.shape[2])) for (r, c), v in np.ndenumerate(x)}
    for part in (1 << 20, 300):
        rows, bands, shape = tiff.read_layers(spark, paths, part=part)
        assert bands == [1, 2, 1, 2, 1] and shape == (11, 7)
        assert {tuple(r)[:3]: r["value"] for r in rows.collect()} == want
        assert rows._jdf.queryExecution().toString().count("BatchScan") == 1
    cut = tiff.read_layers(spark, paths, layers=(2, 3), rows=(4, 6), cols=(2, 2))[0].collect()
    assert {tuple(r)[:3]: r["value"] for r in cut} == {k: v for k, v in want.items() if k[0] in (2, 3) and 4 <= k[1] <= 6 and k[2] == 2}
    assert {tuple(r)[:3] for r in tiff._by_spark(spark, [[p, t, None] for p, t in zip(paths, (1, 2, 4, 5, 7))], {"row": [2, 2]}).collect()} == {k for k in want if k[1] == 2}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = tiff.read_layers(spark, paths)[0].where("t = 5 and row > 9 and col <= 2 and value > 0")
        assert {tuple(r)[:3] for r in some.collect()} == {k for k, v in want.items() if k[0] == 5 and k[1] > 9 and k[2] <= 2 and v > 0}
        assert "(t#" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("BatchScan")[0].replace("isnotnull(t#", "")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="shape"):
        tiff.read_layers(spark, [*paths, by_hand(tmp_path / "other.tif", IMAGE[:5])])
    listed = readers.read_ordered_stack(spark, files=paths, time=[1, 2, 3, 4, 5, 6, 9])
    assert listed.n == 7 and [r["layer_name"] for r in listed.layers.orderBy("t").collect()][:3] == ["f0", "f1", "f1_1"]
    with pytest.raises(ValueError):
        readers.read_ordered_stack(spark, files=paths, time=[1, 2, 3, 4, 5])
    with pytest.raises(ValueError, match="several layers"):
        readers.read_ordered_stack(spark, directory=str(tmp_path), pattern=r"f\d\.tif$")


@pytest.mark.parametrize("options", [{}, {"compression": "none", "strip": "4"}, {"predictor": "2", "strip": "4"}, {"dtype": "f4"}])
def test_written_layers_come_back(spark, tmp_path, options):
    long = spark.range(30 * 7 * 12).select((F.col("id") % 12 + 1).alias("t"), (F.floor(F.col("id") / 12) % 30 + 1).alias("row"), (F.floor(F.col("id") / 360) + 1).alias("col"), F.when(F.col("id") % 11 > 0, F.col("id") * 1.5).alias("value"))
    tiff.write_layers(long, str(tmp_path / "a"), 30, 7, name="year{t}.tif", **options)
    got = readers.read_ordered_stack(spark, directory=str(tmp_path / "a"))
    assert [r["layer_name"] for r in got.layers.orderBy("t").collect()] == [f"year{t}" for t in range(1, 13)] and got.n == 12
    want = {(r["t"], (r["row"] - 1) * 7 + r["col"], r["value"]) for r in long.collect()}
    assert {(r["t"], r["cell"], r["value"]) for r in got.values.collect()} == want
    with pytest.raises(Exception, match="there already"):
        tiff.write_layers(long, str(tmp_path / "a"), 30, 7, name="year{t}.tif")
    tiff.write_layers(long.where("t = 3"), str(tmp_path / "a"), 30, 7, name="year{t}.tif", mode="overwrite")
    with pytest.raises(ValueError, match="twice"):
        tiff.write_layers(long.union(long), str(tmp_path / "b"), 30, 7)
    with pytest.raises(Exception, match="outside"):
        tiff.write_layers(long, str(tmp_path / "c"), 29, 7)
    assert not [p for p in tmp_path.rglob("_temporary*")]


def cdf(path, version, times, cube, units="days since 2000-01-01", calendar=None, record=True, y=None, kind=">f8", extra=b"", attributes=(), streamed=False, n_vars=1):
    """A NetCDF classic file of cubes (time, y, x), written field by field."""
    word = ">q" if version == 5 else ">i"
    text = lambda s: struct.pack(word, len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    n, rows, cols = cube.shape
    number = {">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6}
    dims = struct.pack(">i", 10) + struct.pack(word, 3) + text("time") + struct.pack(word, 0 if record else n) + text("y") + struct.pack(word, rows) + text("x") + struct.pack(word, cols)
    none = struct.pack(">i", 0) + struct.pack(word, 0)

    def atts(pairs):
        if not pairs:
            return none
        out = struct.pack(">i", 12) + struct.pack(word, len(pairs))
        for name, value in pairs:
            raw, k, m = (value.encode(), 2, len(value)) if isinstance(value, str) else (np.array([value[1]], value[0]).tobytes(), number[value[0]], 1)
            out += text(name) + struct.pack(">i", k) + struct.pack(word, m) + raw + b"\0" * (-len(raw) % 4)
        return out

    specs = [("time", [0], ">f8", [(a, v) for a, v in (("units", units), ("calendar", calendar)) if v], times.astype(">f8"))]
    if y is not None:
        specs.append(("y", [1], ">f4", (), np.array(y, ">f4")))
    specs += [("v" if k == 0 else f"v{k}", [0, 1, 2], kind, attributes, cube.astype(kind)) for k in range(n_vars)]
    place, size = (">i" if version == 1 else ">q"), (lambda x: x.nbytes // (n if record else 1))
    fixed = [s for s in specs if not (record and s[1][0] == 0)]
    moving = [s for s in specs if record and s[1][0] == 0]

    def header(begins):
        out = b"CDF" + bytes([version]) + (struct.pack(word, -1) if streamed else struct.pack(word, n if record else 0)) + dims + none + struct.pack(">i", 11) + struct.pack(word, len(specs))
        for s in specs:
            vsize = (size(s[4]) if s in moving else s[4].nbytes)
            out += text(s[0]) + struct.pack(word, len(s[1])) + b"".join(struct.pack(word, d) for d in s[1]) + atts(s[3]) + struct.pack(">i", number[s[2]]) + struct.pack(word, vsize + -vsize % 4) + struct.pack(place, begins[s[0]])
        return out

    at, begins = len(header({s[0]: 0 for s in specs})), {}
    for s in fixed:
        begins[s[0]] = at
        at += s[4].nbytes + -s[4].nbytes % 4
    for s in moving:
        begins[s[0]] = at
        at += size(s[4]) + -size(s[4]) % 4
    body = b"".join(s[4].tobytes() + b"\0" * (-s[4].nbytes % 4) for s in fixed)
    for k in range(n if record else 0):
        body += b"".join(s[4][k : k + 1].tobytes() + b"\0" * (-s[4][k : k + 1].nbytes % 4) for s in moving)
    path.write_bytes(header(begins) + body)
    return str(path)


CUBE = RNG.integers(-50, 50, (4, 3, 5)).astype(float)


@pytest.mark.parametrize("how", [{"version": 1}, {"version": 2, "record": False}, {"version": 5}, {"version": 2, "kind": ">i2"}, {"version": 1, "y": [10, 20, 30]}, {"version": 1, "y": [30, 20, 10], "kind": ">f4"}, {"version": 2, "streamed": True}, {"version": 2, "attributes": (("scale_factor", (">f8", 0.5)), ("add_offset", (">f8", 3.0)), ("_FillValue", (">f8", CUBE[1, 1, 1]))) }])
def test_cubes_by_hand(spark, tmp_path, how):
    path = cdf(tmp_path / "c.nc", how.pop("version"), np.array([31.0, 0.0, 366.0, 1.5]), CUBE, **how)
    order = [1, 3, 0, 2]
    want = CUBE[order][:, ::-1] if how.get("y") == [10, 20, 30] else CUBE[order]
    if "attributes" in how:
        want = np.where(want == CUBE[1, 1, 1], np.nan, want * 0.5 + 3)
    for part in (1 << 20, 40, 200):
        rows, times, shape = netcdf.read_cube(spark, path, part=part)
        assert shape == (3, 5) and times == [datetime(2000, 1, 1), datetime(2000, 1, 2, 12), datetime(2000, 2, 1), datetime(2001, 1, 1)]
        back = np.full(want.shape, np.inf)
        for r in rows.collect():
            back[r["t"] - 1, r["row"] - 1, r["col"] - 1] = np.nan if r["value"] is None else r["value"]
        assert np.array_equal(back, want, equal_nan=True)
    cut = netcdf.read_cube(spark, path, layers=(2, 3), rows=(2, 2))[0]
    assert {(r["t"], r["row"]) for r in cut.collect()} == {(2, 2), (3, 2)} and cut.count() == 10


def test_refused_cubes(spark, tmp_path):
    t = np.array([0.0, 1.0, 2.0, 3.0])
    for k, (times, how) in enumerate(((np.array([0.0, 1.0, 1.0, 2.0]), {}), (np.array([0.0, np.nan, 1.0, 2.0]), {}), (t, {"units": "fortnights since 2000-01-01"}), (t, {"n_vars": 2}), (t, {"calendar": "360_day"}))):
        with pytest.raises(ValueError):
            netcdf.read_cube(spark, cdf(tmp_path / f"{k}.nc", 1, times, CUBE, **how))
    two = cdf(tmp_path / "two.nc", 1, t, CUBE, n_vars=2)
    assert netcdf.read_cube(spark, two, "v1")[0].count() == 60
    with pytest.warns(UserWarning, match="seasonal"):
        got = readers.read_netcdf_stack(spark, two, "v")
    assert got.n == 4 and got.layers.orderBy("t").first()["time"] == "2000-01-01 00:00:00"
    assert netcdf.cf_times(np.array([59.0, 365.0]), "days since 2000-01-01", "noleap") == [datetime(2000, 3, 1), datetime(2001, 1, 1)]
    assert netcdf.cf_times(np.array([36.0]), "hours since 2000-01-01 12:00:00", None) == [datetime(2000, 1, 3)] and netcdf.cf_times(np.array([7]), None, None) == [7.0]


@pytest.mark.parametrize("per_file", [None, 3])
def test_written_cubes_come_back(spark, tmp_path, per_file):
    long = spark.range(7 * 4 * 5).select((F.col("id") % 7 + 1).alias("t"), (F.floor(F.col("id") / 7) % 4 + 1).alias("row"), (F.floor(F.col("id") / 28) + 1).alias("col"), (F.col("id") * 1.5).alias("value")).where("id % 3 > 0 and t <> 4")
    netcdf.write_cube(long, str(tmp_path / "n"), 4, 5, range(7), "price", "days since 2020-01-01", per_file=per_file)
    files = sorted(str(p) for p in (tmp_path / "n").iterdir() if p.suffix == ".nc")
    assert len(files) == (1 if per_file is None else 3)
    rows, times, shape = netcdf.read_cube(spark, files[::-1], "price")
    assert shape == (4, 5) and times == [datetime(2020, 1, d) for d in range(1, 8)] and rows.count() == 140
    assert {tuple(r) for r in rows.where("value is not null").collect()} == {tuple(r) for r in long.collect()}
    with pytest.raises(ValueError, match="twice"):
        netcdf.read_cube(spark, [*files, files[0]])

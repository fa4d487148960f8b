"""GeoTIFF rasters as a Python data source: windows read by their tiles, files written with overviews, in BigTIFF.

Reading: a partition is a run of tiles; it seeks to them and decodes nothing else, so a window or an overview touches only
its own bytes. Deflate or none, predictors 1 to 3, tiles or strips, bands together or apart, both byte orders. Writing:
tiles are made and packed by tasks of their own; one task a file then streams the packed tiles behind a head whose size is
known before, so it holds none but the one at hand. A raster is divided into files of `side` x `side` cells. Files appear
under their names when the whole job commits. Paths are those that all machines open alike (a mounted folder).
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tellur.operators.change import overview_levels, pyramid
from tellur.operators.ranges import attached
from tellur.sources.cells import keys

#: Tags and field types of the format (fixed values): names by number; struct codes and sizes by type.
TAGS = {
    254: "kind", 256: "cols", 257: "rows", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "bands", 278: "strip_rows", 279: "strip_counts", 284: "planar", 317: "predictor",
    322: "tile_cols", 323: "tile_rows", 324: "tile_offsets", 325: "tile_counts", 339: "sample", 33550: "scale", 33922: "tie", 34735: "geo", 42113: "nodata",
}
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
#: Geographic and projected CRS in the directory of keys, sample formats by numpy's kinds, compressions that can be read (fixed values).
CRS_KEYS, SAMPLES, COMPRESSIONS = (3072, 2048), {"u": 1, "i": 2, "f": 3}, {1: "none", 8: "deflate", 32946: "deflate"}


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def read_head(path: str) -> list[dict]:
    """The directories of a file, the full raster first, then its overviews; raises for other files."""
    with open(local(path), "rb") as f:
        first = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(first[:2])
        magic = struct.unpack(f"{order or '<'}H", first[2:4])[0] if len(first) >= 8 else 0
        if not order or magic not in (42, 43):
            raise ValueError(f"{path} isn't a TIFF")
        big = magic == 43
        at = struct.unpack(f"{order}Q", first[8:16])[0] if big else struct.unpack(f"{order}I", first[4:8])[0]
        out, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            f.seek(at)
            n = struct.unpack(f"{order}Q" if big else f"{order}H", f.read(8 if big else 2))[0]
            size, tags = (20 if big else 12), {"order": order}
            entries = f.read(n * size)
            at = struct.unpack(f"{order}Q" if big else f"{order}I", f.read(8 if big else 4))[0]
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHQ" if big else f"{order}HHI", entries, k * size)
                if tag not in TAGS or kind not in TYPES:
                    continue
                code, width = TYPES[kind]
                raw = entries[k * size + (12 if big else 8) : (k + 1) * size]
                if count * width > len(raw):
                    f.seek(struct.unpack(f"{order}Q" if big else f"{order}I", raw)[0])
                    raw = f.read(count * width)
                tags[TAGS[tag]] = raw[:count].rstrip(b"\0").decode("latin-1") if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", raw[: count * width])
            out.append(_described(tags, path))
    return [out[0], *(d for d in out[1:] if d["kind"] & 1)]


def _described(t: dict, path: str) -> dict:
    one = lambda k, otherwise: t[k][0] if t.get(k) else otherwise
    d = {"order": t["order"], "kind": one("kind", 0), "rows": one("rows", 0), "cols": one("cols", 0), "bands": one("bands", 1), "planar": one("planar", 1), "predictor": one("predictor", 1), "compression": one("compression", 1)}
    if d["compression"] not in COMPRESSIONS:
        raise ValueError(f"{path}: compression {d['compression']} can't be read")
    kind = {v: k for k, v in SAMPLES.items()}.get(one("sample", 1))
    if kind is None or one("bits", 1) not in (8, 16, 32, 64):
        raise ValueError(f"{path}: samples of this kind can't be read")
    d["dtype"] = f"{kind}{one('bits', 8) // 8}"
    tiled = "tile_offsets" in t
    d |= {"tile_rows": one("tile_rows", 0) if tiled else min(one("strip_rows", d["rows"]), d["rows"]), "tile_cols": one("tile_cols", 0) if tiled else d["cols"], "tiled": tiled}
    d |= {"offsets": t.get("tile_offsets" if tiled else "strip_offsets", ()), "counts": t.get("tile_counts" if tiled else "strip_counts", ())}
    scale, tie, geo = t.get("scale"), t.get("tie"), t.get("geo", ())
    codes = {geo[i]: geo[i + 3] for i in range(4, len(geo) - 3, 4) if geo[i + 1] == 0}
    d |= {"epsg": next((codes[k] for k in CRS_KEYS if 0 < codes.get(k, 0) < 32767), None), "px_w": scale[0] if scale else None, "px_h": -scale[1] if scale else None}
    d |= {"x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1]} if scale and tie else {"x0": None, "y0": None}
    try:
        d["nodata"] = float(t["nodata"]) if t.get("nodata") else None
    except ValueError:
        d["nodata"] = None
    return d


def unpacked(data: bytes, d: dict) -> np.ndarray:
    """(rows, cols, samples) of a packed tile; a strip at the end may be short."""
    raw = zlib.decompress(data) if COMPRESSIONS[d["compression"]] == "deflate" else data
    kind, samples = np.dtype(d["order"] + d["dtype"]), d["bands"] if d["planar"] == 1 else 1
    row = d["tile_cols"] * samples
    rows = len(raw) // (row * kind.itemsize)
    raw = np.frombuffer(raw, np.uint8, rows * row * kind.itemsize)
    if d["predictor"] == 3:  # bytes of a row by significance, each as the difference to the one before
        planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, row)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">{d['dtype']}").reshape(rows, d["tile_cols"], samples)
    x = raw.view(kind).reshape(rows, d["tile_cols"], samples)
    return np.cumsum(x, axis=1, dtype=x.dtype) if d["predictor"] == 2 else x


def packed(x: np.ndarray) -> bytes:
    """A tile (rows, cols) by predictor and deflate: 3 for floats, 2 for integers."""
    if x.dtype.kind == "f":
        planes = np.ascontiguousarray(x.astype(f">{x.dtype.str[1:]}")).view(np.uint8).reshape(*x.shape, x.dtype.itemsize).transpose(0, 2, 1).reshape(len(x), -1)
        return zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes(), 6)
    return zlib.compress(np.diff(x, axis=1, prepend=x.dtype.type(0)).tobytes(), 6)


@dataclass
class Run(InputPartition):
    """Some tiles of a directory of a file, and the row and column of its first cell."""

    path: str
    level: int
    tiles: list[int]
    row: int = 0
    col: int = 0


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.level, self.at_once = local(options["path"]), int(options.get("level", 0)), int(options.get("tiles", 64))
        self.window = tuple(map(int, options["window"].split(","))) if options.get("window") else None
        self.grid = tuple(map(float, options["grid"].split(","))) if options.get("grid") else None

    def place(self, d: dict, path: str) -> tuple[int, int]:
        """Row and column of a file's first cell: its own, or those of the grid by where the file lies; of an overview at its scale."""
        if not self.grid:
            return 0, 0
        if d["x0"] is None:
            raise ValueError(f"{path} doesn't say where it lies")
        x0, y0, px_w, px_h = self.grid
        return round((d["y0"] - y0) / px_h) // 2**self.level, round((d["x0"] - x0) / px_w) // 2**self.level

    def inside(self, d: dict, row: int, col: int) -> tuple[int, int, int, int]:
        """First and last row and column of the window, counted from the file's first cell."""
        if not self.window:
            return 0, d["rows"], 0, d["cols"]
        r0, r1, c0, c1 = self.window
        return r0 - row, r1 - row, c0 - col, c1 - col

    def partitions(self) -> list[Run]:
        out = []
        for path in files(self.path):
            heads = read_head(path)
            if self.level >= len(heads):
                continue
            d = heads[self.level]
            across, down = -(-d["cols"] // d["tile_cols"]), -(-d["rows"] // d["tile_rows"])
            row, col = self.place(heads[0], path)
            r0, r1, c0, c1 = self.inside(d, row, col)
            rows, cols = range(max(0, r0 // d["tile_rows"]), min(down - 1, r1 // d["tile_rows"]) + 1), range(max(0, c0 // d["tile_cols"]), min(across - 1, c1 // d["tile_cols"]) + 1)
            tiles = [b * across * down + r * across + c for b in range(d["bands"] if d["planar"] == 2 else 1) for r in rows for c in cols]
            out += [Run(path, self.level, tiles[i : i + self.at_once], row, col) for i in range(0, len(tiles), self.at_once)]
        return out

    def read(self, part: Run | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        d = read_head(part.path)[part.level]
        across, down = -(-d["cols"] // d["tile_cols"]), -(-d["rows"] // d["tile_rows"])
        r0, r1, c0, c1 = self.inside(d, part.row, part.col)
        with open(part.path, "rb") as f:
            for t in part.tiles:
                if not d["counts"][t]:
                    continue  # a tile that was left out has no cells
                f.seek(d["offsets"][t])
                x = unpacked(f.read(d["counts"][t]), d)
                band, at = divmod(t, across * down)
                top, left = at // across * d["tile_rows"], at % across * d["tile_cols"]
                rr, cc = np.arange(len(x)) + top, np.arange(x.shape[1]) + left
                rows, cols = (rr >= r0) & (rr <= r1) & (rr < d["rows"]), (cc >= c0) & (cc <= c1) & (cc < d["cols"])
                x, rr, cc = x[np.ix_(rows, cols)], rr[rows] + part.row, cc[cols] + part.col
                for k in range(x.shape[2]):
                    z = x[:, :, k].astype(float).ravel()
                    none = np.isnan(z) if d["nodata"] is None else np.isnan(z) | (np.abs(z - d["nodata"]) <= 1e-5)
                    n, b = len(z), (band if d["planar"] == 2 else k) + 1
                    cells = [pa.array([part.path] * n, pa.string()), pa.array(np.full(n, b, np.int32)), pa.array(np.repeat(rr, len(cc)).astype(np.int32)), pa.array(np.tile(cc, len(rr)).astype(np.int32)), pa.array(z, mask=none)]
                    yield pa.RecordBatch.from_arrays(cells, names=["file", "band", "r", "c", "z"])


def files(path: str) -> list[str]:
    return [path] if os.path.isfile(path) else sorted(glob.glob(f"{glob.escape(path)}/**/*.tif", recursive=True))


def head(file: dict, offsets: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """The head of a BigTIFF: one directory for the raster and one for each overview, each with its arrays behind it. Its size doesn't depend on the offsets."""
    out = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
    kind, tile = np.dtype(file["dtype"]), file["tile"]
    for level, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        rows, cols = (-(-file[k] // 2**level) for k in ("rows", "cols"))
        bands = file["bands"]
        fields = [
            (254, 4, [int(level > 0)]), (256, 4, [cols]), (257, 4, [rows]), (258, 3, [kind.itemsize * 8] * bands), (259, 3, [8]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [2]), (317, 3, [3 if kind.kind == "f" else 2]),
            (322, 4, [tile]), (323, 4, [tile]), (324, 16, at.tolist()), (325, 16, n.tolist()), (339, 3, [SAMPLES[kind.kind]] * bands),
        ]
        if level == 0:
            fields += [(33550, 12, [file["px_w"], -file["px_h"], 0.0]), (33922, 12, [0.0, 0.0, 0.0, file["x0"], file["y0"], 0.0])]
            if file["epsg"]:
                flat = file["epsg"] == 4326
                fields.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if flat else 1, CRS_KEYS[1] if flat else CRS_KEYS[0], 0, 1, file["epsg"]]))
        fields.append((42113, 2, f"{file['nodata']!r}\0".encode()))
        start = len(out)
        end = start + 8 + 20 * len(fields) + 8
        entries, more = bytearray(), bytearray()
        for tag, k, v in fields:
            raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{TYPES[k][0]}", *v)
            entries += struct.pack("<HHQ", tag, k, len(v))
            if len(raw) <= 8:
                entries += raw.ljust(8, b"\0")
            else:
                entries += struct.pack("<Q", end + len(more))
                more += raw.ljust(-(-len(raw) // 8) * 8, b"\0")
        after = 0 if level == len(offsets) - 1 else end + len(more)
        out += struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", after) + more
    return bytes(out)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Rows are packed tiles, those of a file together and one after the other."""

    def __init__(self, options: dict):
        self.path = local(options["path"])

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, f, name, info = [], None, None, {}

        def close() -> None:
            f.seek(0)
            f.write(head(info, offsets, counts))
            f.close()

        for r in rows:
            if r.file != name:
                if f:
                    close()
                name = r.file
                info = {k: r[k] for k in ("rows", "cols", "bands", "tile", "dtype", "x0", "y0", "px_w", "px_h", "epsg", "nodata")}
                across = lambda k, level: -(-(-(-info[k] // 2**level)) // info["tile"])
                sizes = [info["bands"] * across("rows", v) * across("cols", v) for v in range(r.levels + 1)]
                offsets, counts = [np.zeros(n, np.int64) for n in sizes], [np.zeros(n, np.int64) for n in sizes]
                done.append((f"{self.path}/.{name}-{uuid.uuid4().hex}.part", f"{self.path}/{name}.tif"))
                f = open(done[-1][0], "wb")  # noqa: SIM115  closed when the next file begins
                f.write(bytes(len(head(info, offsets, counts))))
            at = (r.band - 1) * across("rows", r.level) * across("cols", r.level) + r.tr * across("cols", r.level) + r.tc
            offsets[r.level][at], counts[r.level][at] = f.tell(), len(r.data)
            f.write(r.data)
        if f:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for part, name in (x for m in messages if m for x in m.names):
            os.replace(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        for part, _ in (x for m in messages if m for x in m.names):
            if os.path.exists(part):
                os.remove(part)


class GeoTiff(DataSource):
    """Format `geotiff`: options path, window (first and last row, first and last column), level (0: the raster, then its overviews), grid (x0, y0, px_w, px_h of cell (0, 0); without it each file counts its own cells), tiles (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "file string, band int, r int, c int, z double"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("rasters that are there aren't overwritten; append to a new folder")
        return Writer(dict(self.options))


def read_geotiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, level: int = 0, grid: dict | None = None) -> DataFrame:
    """(file, band, r, c, z) of the rasters under a path, or of a window of each; nodata is NULL. An overview that a file lacks gives none.

    Each file counts its cells from its own first one. With the `grid` that `write_geotiff` was given they are those of the
    raster, which may be divided into several files, and so is the window.
    """
    spark.dataSource.register(GeoTiff)
    given = {"window": ",".join(map(str, window))} if window else {}
    if grid:
        given["grid"] = ",".join(repr(float(grid[k])) for k in ("x0", "y0", "px_w", "px_h"))
    return spark.read.format("geotiff").options(level=level, **given).load(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, cols, bands, x0, y0, px_w, px_h, epsg, nodata, block, overviews) of the rasters under a path, from their heads."""
    kind = "file string, rows bigint, cols bigint, bands int, x0 double, y0 double, px_w double, px_h double, epsg int, nodata double, block int, overviews int"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            heads = [(x, read_head(x)) for x in f.file]
            yield pd.DataFrame([(x, *(d[0][k] for k in ("rows", "cols", "bands", "x0", "y0", "px_w", "px_h", "epsg", "nodata")), min(d[0]["tile_rows"], d[0]["tile_cols"]), len(d) - 1) for x, d in heads], columns=[c.split()[0] for c in kind.split(", ")])

    names = files(local(path))
    return spark.createDataFrame([(x,) for x in names], "file string").repartition(max(1, min(len(names), 64))).mapInPandas(work, kind)


def mosaic(meta: DataFrame) -> DataFrame:
    """The rows of `read_meta` with rows, cols, x0 and y0 of the whole raster, for rasters that are divided into files <raster_id>_<row>_<column>.tif."""
    named = meta.withColumn("raster", F.regexp_replace("file", r"_\d+_\d+\.tif$", ""))
    ends = {k: (F.signum(f"px_{w}") * F.col(f"{x}0"), F.signum(f"px_{w}") * (F.col(f"{x}0") + F.col(k) * F.col(f"px_{w}"))) for k, x, w in (("rows", "y", "h"), ("cols", "x", "w"))}
    said = named.groupBy("raster").agg(
        *(F.round((F.max(last) - F.min(first)) / F.max(F.abs(f"px_{w}"))).cast("bigint").alias(k) for k, w in (("rows", "h"), ("cols", "w")) for first, last in [ends[k]]),
        F.min_by("x0", ends["cols"][0]).alias("x0"),
        F.min_by("y0", ends["rows"][0]).alias("y0"),
    )
    return named.drop("rows", "cols", "x0", "y0").join(said, "raster").select(*meta.columns)


def write_geotiff(cells: DataFrame, path: str, grid: dict, epsg: int | None = None, dtype: str = "float64", nodata: float = -9999.0, tile: int = 256, side: int = 4_096, levels: int | None = None, kind: str = "average") -> None:
    """Writes rasters ([raster_id,] r, c, bands...) with overviews as files <raster_id>_<row>_<column>.tif under a path, a file for each block of side x side cells.

    `grid` has x0, y0, px_w and px_h of cell (0, 0); overviews are as many as `overview_levels` says for a block, made by
    `pyramid`. Missing cells and tiles are nodata. Fails if there are rasters under the path.
    """
    if side % (tile * 16) and side % tile:
        raise ValueError("side is a multiple of tile")
    spark, by = cells.sparkSession, keys(cells)
    if files(local(path)):
        raise ValueError(f"{path} holds rasters")
    bands = [c for c in cells.columns if c not in (*by, "r", "c")]
    box = cells.groupBy(*by).agg(*(f(x).alias(f"_{x}{k}") for x in "rc" for k, f in ((0, F.min), (1, F.max)))).where("_r0 IS NOT NULL")
    x = attached(cells, box) if box.limit(1).count() else cells.limit(0).withColumns({f"_{k}{i}": F.lit(0) for k in "rc" for i in (0, 1)})
    ends = ["_r0", "_r1", "_c0", "_c1"]
    most = box.agg(F.max(F.col("_r1") - F.col("_r0") + 1), F.max(F.col("_c1") - F.col("_c0") + 1)).first()
    if levels is None:
        levels = overview_levels(*(min(side, n) for n in most)) if most[0] is not None else 0
    while levels and side % (tile * 2**levels):
        levels -= 1
    moved = x.select(*by, (F.col("r") - F.col("_r0")).alias("r"), (F.col("c") - F.col("_c0")).alias("c"), *bands)
    parts = []
    for i, b in enumerate(bands, 1):
        own = moved.select(*by, "r", "c", F.col(b).cast("double").alias("z"))
        parts.append(own.select(*by, F.lit(i).alias("band"), F.lit(0).alias("level"), "r", "c", "z"))
        if levels:
            parts.append(pyramid(own, levels, kind).select(*by, F.lit(i).alias("band"), "level", "r", "c", "z"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    wide = F.floor(F.lit(side) / F.pow(F.lit(2), F.col("level"))).cast("int")
    every = attached(every, box) if box.limit(1).count() else every.withColumns({e: F.lit(0) for e in ends})
    every = every.withColumns({"br": F.floor(F.col("r") / wide), "bc": F.floor(F.col("c") / wide)}).withColumns({"tr": F.floor((F.col("r") - F.col("br") * wide) / tile).cast("int"), "tc": F.floor((F.col("c") - F.col("bc") * wide) / tile).cast("int")})

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        own, (br, bc, band, level, tr, tc) = key[:-6], (int(v) for v in key[-6:])
        r0, r1, c0, c1 = (int(f[e].iloc[0]) for e in ends)
        out = np.full((tile, tile), nodata, dtype)
        z = f.z.to_numpy(float)
        wide = side // 2**level
        out[f.r.to_numpy() - br * wide - tr * tile, f.c.to_numpy() - bc * wide - tc * tile] = np.where(np.isnan(z), nodata, z)
        rows, cols = min(side, r1 + 1 - r0 - br * side), min(side, c1 + 1 - c0 - bc * side)
        place = [grid["x0"] + (c0 + bc * side) * grid["px_w"], grid["y0"] + (r0 + br * side) * grid["px_h"], grid["px_w"], grid["px_h"]]
        name = "_".join(str(v) for v in (*(own or ("raster",)), br, bc))
        return pd.DataFrame([(name, band, level, tr, tc, rows, cols, len(bands), tile, dtype, levels, *map(float, place), epsg, float(nodata), packed(out))], columns=names)

    schema = "file string, band int, level int, tr int, tc int, rows int, cols int, bands int, tile int, dtype string, levels int, x0 double, y0 double, px_w double, px_h double, epsg int, nodata double, data binary"
    names = [c.split()[0] for c in schema.split(", ")]
    tiles = every.groupBy(*by, "br", "bc", "band", "level", "tr", "tc").applyInPandas(pack, schema)
    spark.dataSource.register(GeoTiff)
    tiles.repartition("file").sortWithinPartitions("file", F.desc("level"), "band", "tr", "tc").write.format("geotiff").mode("append").save(path)

"""LAS point clouds, versions 1.0 to 1.4, without compression, as a Python data source and sink.

A partition is a range of a file's points, whatever the file's size; files whose bounds lie outside an asked box aren't
opened beyond their heads. Writing streams points behind a head that is filled in at the end, and files appear under their
names when the whole job commits. Paths are those that all machines open alike; those of a store that only Spark reads are
read by its own source of whole files, of 2 GB at most.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tellur.sources.geotiff import local

#: Bytes of a header of version 1.2 and of a point of format 0, and places in headers (fixed values of the format).
HEADER, POINT = 227, 20
SCALE = 0.001
#: Points in a file and in a partition, at most.
PER_FILE, AT_ONCE = 20_000_000, 1_000_000
SCHEMA = "x double, y double, z double, intensity int, classification int"
#: Keys of a projected and of a geographic CRS in the directory of GeoTIFF keys (fixed values of the format).
CRS_KEYS = (3072, 2048)


def header(data: bytes) -> dict:
    """What the header and the records behind it say; raises for other files and for compressed ones."""
    if data[:4] != b"LASF" or len(data) < HEADER:
        raise ValueError("not a LAS file")
    kind, size, old_count = struct.unpack_from("<BHI", data, 104)
    if kind & 0xC0:
        raise ValueError("compressed points (LAZ) can't be read")
    out = {"format": kind, "size": size, "start": struct.unpack_from("<I", data, 96)[0], "scale": struct.unpack_from("<3d", data, 131), "offset": struct.unpack_from("<3d", data, 155), "bounds": struct.unpack_from("<6d", data, 179), "epsg": None, "wkt": None}
    out["n"] = struct.unpack_from("<Q", data, 247)[0] if data[25] >= 4 and len(data) >= 255 else old_count
    at = struct.unpack_from("<H", data, 94)[0]
    for _ in range(struct.unpack_from("<I", data, 100)[0]):
        if at + 54 > len(data):
            break
        user, number, length = struct.unpack_from("<16sHH", data, at + 2)
        body = data[at + 54 : at + 54 + length]
        if user.rstrip(b"\0") == b"LASF_Projection":
            if number == 2112:
                out["wkt"] = body.rstrip(b"\0").decode("utf-8", "replace") or None
            elif number == 34735:
                keys = np.frombuffer(body[: len(body) // 8 * 8], "<u2").reshape(-1, 4)[1:]
                codes = {int(k[0]): int(k[3]) for k in keys if k[1] == 0}
                out["epsg"] = next((codes[k] for k in CRS_KEYS if 0 < codes.get(k, 0) < 32767), None)
        at += 54 + length
    return out


def decoded(raw: np.ndarray, h: dict) -> Iterator[pa.RecordBatch]:
    """Points (rows of bytes) by the ten thousands."""
    for at in range(0, len(raw), 50_000):
        own = raw[at : at + 50_000]
        xyz = np.ascontiguousarray(own[:, :12]).view("<i4")
        kind = own[:, 16] if h["format"] >= 6 else own[:, 15] & 31
        columns = [xyz[:, k] * h["scale"][k] + h["offset"][k] for k in range(3)]
        columns += [np.ascontiguousarray(own[:, 12:14]).view("<u2")[:, 0].astype(np.int32), kind.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "z", "intensity", "classification"])


def files(path: str) -> list[str]:
    """The LAS files under a path, without empty ones."""
    found = [path] if os.path.isfile(path) else glob.glob(f"{glob.escape(path)}/**/*.[lL][aA][sS]", recursive=True)
    return sorted(f for f in found if os.path.getsize(f))


def read_head(path: str) -> dict:
    """`header` of a file, of which no more is read than lies before its points, and how many of them are `there`."""
    with open(path, "rb") as f:
        first = f.read(375)
        start = struct.unpack_from("<I", first, 96)[0] if len(first) >= HEADER else 0
        h = header(first + f.read(max(0, start - len(first))))
    return h | {"there": min(h["n"], max(0, os.path.getsize(path) - h["start"]) // h["size"])}


@dataclass
class Range(InputPartition):
    path: str
    first: int
    n: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.at_once = local(options["path"]), int(options.get("points", AT_ONCE))
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            h = read_head(path)
            x1, x0, y1, y0 = h["bounds"][:4]
            if self.box and x1 >= x0 and (x0 > self.box[2] or x1 < self.box[0] or y0 > self.box[3] or y1 < self.box[1]):
                continue
            out += [Range(path, i, min(self.at_once, h["there"] - i)) for i in range(0, h["there"], self.at_once)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        h = read_head(part.path)
        with open(part.path, "rb") as f:
            f.seek(h["start"] + part.first * h["size"])
            for b in decoded(np.frombuffer(f.read(part.n * h["size"]), np.uint8).reshape(-1, h["size"]), h):
                if self.box:
                    x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
                    b = b.filter(pa.array((x >= self.box[0]) & (x <= self.box[2]) & (y >= self.box[1]) & (y <= self.box[3])))
                yield b


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Points (x, y, z, intensity, classification) as LAS 1.2, to the millimetre, a file for each partition or more."""

    def __init__(self, options: dict):
        self.path, self.most = local(options["path"]), int(options.get("most", PER_FILE))
        epsg = int(options.get("epsg", 0))
        keys = np.array([[1, 1, 0, 1], [CRS_KEYS[0], 0, 1, epsg]], "<u2").tobytes()
        self.record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys if epsg else b""

    def head(self, n: int, offset: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
        head = bytearray(HEADER)
        head[:4], head[24], head[25] = b"LASF", 1, 2
        struct.pack_into("<HII", head, 94, HEADER, HEADER + len(self.record), int(bool(self.record)))
        struct.pack_into("<BHI", head, 104, 0, POINT, n)
        struct.pack_into("<I", head, 111, n)
        struct.pack_into("<6d", head, 131, *[SCALE] * 3, *offset)
        struct.pack_into("<6d", head, 179, *(v for k in range(3) for v in (high[k], low[k])))
        return bytes(head) + self.record

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, f, n, number = [], None, 0, TaskContext.get().partitionId()

        def close() -> None:
            f.seek(0)
            f.write(self.head(n, offset, low, high))
            f.close()

        for lot in lots(rows, min(50_000, self.most)):
            x = np.array([(r.x, r.y, r.z) for r in lot], float)
            places = np.round((x - offset) / SCALE) if f else x
            if f and (n + len(x) > self.most or np.abs(places).max() >= 2**31):
                close()
                f = None
            if not f:
                name = f"part-{number:05d}-{len(done):03d}"
                done.append((f"{self.path}/.{name}-{uuid.uuid4().hex}.part", f"{self.path}/{name}.las"))
                f = open(done[-1][0], "wb")  # noqa: SIM115  closed when the next file begins
                offset, low, high, n = np.floor(x.min(axis=0)), x.min(axis=0), x.max(axis=0), 0
                f.write(self.head(0, offset, low, high))
                places = np.round((x - offset) / SCALE)
            out = np.zeros(len(x), np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("kind", "u1"), ("rest", "u1", 4)]))
            out["xyz"] = places
            out["intensity"] = [min(max(r.intensity or 0, 0), 65535) for r in lot]
            out["kind"] = [min(max(r.classification or 0, 0), 31) for r in lot]
            f.write(out.tobytes())
            low, high, n = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)), n + len(x)
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


def lots(rows: Iterator, size: int) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class Las(DataSource):
    """Format `las`: options path, box (x0,y0,x1,y1), points (of a partition); to write path, epsg, most (points of a file)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, epsg, wkt) of each LAS file under a path, for the CRS of a cloud."""
    kind = "file string, n bigint, epsg bigint, wkt string"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [header(c) for c in f.content] if "content" in f else [read_head(x) for x in f.path]
            yield pd.DataFrame({"file": f.path} | {k: [h[k] for h in found] for k in ("n", "epsg", "wkt")}).astype({"epsg": "Int64"})

    if _remote(path):
        return _whole(spark, path).mapInPandas(work, kind)
    names = files(local(path))
    return spark.createDataFrame([(x,) for x in names], "path string").repartition(max(1, min(len(names), 64))).mapInPandas(work, kind)


def read_points(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(x, y, z, intensity, classification) of all LAS files under a path, or of their points within a box (x0, y0, x1, y1), ends included.

    A file that ends early gives the points that it has; empty files give none.
    """
    if not _remote(path):
        spark.dataSource.register(Las)
        return spark.read.format("las").options(**({"box": ",".join(map(repr, map(float, box)))} if box else {})).load(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                h = header(data)
                n = min(h["n"], max(0, len(data) - h["start"]) // h["size"])
                yield from decoded(np.frombuffer(data, np.uint8, n * h["size"], h["start"]).reshape(n, h["size"]), h)

    out = _whole(spark, path).mapInArrow(work, SCHEMA)
    return out.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])) if box else out


def write_points(points: DataFrame, path: str, epsg: int | None = None, most: int = PER_FILE) -> None:
    """Writes points (x, y, z and, if there, intensity and classification) as LAS 1.2 files under a new path, to the millimetre.

    Points with a null place are left out. Raises if there are LAS files under the path.
    """
    if files(local(path)):
        raise ValueError(f"{path} holds clouds")
    points.sparkSession.dataSource.register(Las)
    more = [(F.col(c) if c in points.columns else F.lit(0)).cast("int").alias(c) for c in ("intensity", "classification")]
    rows = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), *more).dropna(subset=["x", "y", "z"])
    rows.write.format("las").options(epsg=epsg or 0, most=most).mode("append").save(path)

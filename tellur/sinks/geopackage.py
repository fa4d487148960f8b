"""GeoPackage tables as a Python data sink: a file for each partition, by the standard library's SQLite.

Features are points (x, y) or boxes (x1, y1, x2, y2), the latter as closed outlines; other columns become attributes. A file
appears under its name when the whole job commits. The folder is one that all machines open alike.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tellur.sources.geotiff import local

#: The file's application number, the tables that the format asks for, and column types by Spark's (fixed values).
APPLICATION, VERSION = 0x47504B47, 10300
TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')),
  min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian SRS', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic SRS', 0, 'NONE', 0, 'undefined', NULL), ('WGS 84', 4326, 'EPSG', 4326, 'EPSG:4326', NULL);
"""
KINDS = {"string": "TEXT", "double": "REAL", "float": "REAL", "int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN"}


def geometry(srs: int, *place: float) -> bytes:
    """The format's header and well-known binary of a point (x, y) or the outline of a box (x1, y1, x2, y2)."""
    head = b"GP\0\1" + struct.pack("<i", srs)
    if len(place) == 2:
        return head + struct.pack("<BI2d", 1, 1, *place)
    x1, y1, x2, y2 = place
    return head + struct.pack("<BIII10d", 1, 3, 1, 5, x1, y1, x2, y1, x2, y2, x1, y2, x1, y1)


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str


class Writer(DataSourceWriter):
    def __init__(self, options: dict, fields: list[tuple[str, str]]):
        self.path, self.table, self.srs = local(options["path"]), options["table"], int(options["srs"])
        self.box = [n for n, _ in fields if n in ("x1", "y1", "x2", "y2")] if {"x1", "y1", "x2", "y2"} <= {n for n, _ in fields} else ["x", "y"]
        self.fields = [(n, KINDS.get(t, "TEXT")) for n, t in fields if n not in self.box]

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        number = TaskContext.get().partitionId()
        done = Written(f"{self.path}/.{number}-{uuid.uuid4().hex}.part", f"{self.path}/{self.table}-{number:05d}.gpkg")
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        db = sqlite3.connect(done.part)
        db.executescript(TABLES)
        db.execute(f"PRAGMA application_id = {APPLICATION}")
        db.execute(f"PRAGMA user_version = {VERSION}")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", (f"EPSG:{self.srs}", self.srs, self.srs, f"EPSG:{self.srs}"))
        db.execute(f"CREATE TABLE {quoted(self.table)} (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom BLOB, {', '.join(f'{quoted(n)} {t}' for n, t in self.fields)})")
        put = f"INSERT INTO {quoted(self.table)} (geom, {', '.join(quoted(n) for n, _ in self.fields)}) VALUES ({', '.join('?' * (1 + len(self.fields)))})"
        ends, half = [None] * 4, len(self.box) // 2

        def made() -> Iterator[tuple]:
            for r in rows:
                place = [r[n] for n in ("x1", "y1", "x2", "y2")] if half == 2 else [r.x, r.y]
                xs, ys = place[0::2], place[1::2]
                for i, v in enumerate((min(xs), min(ys), max(xs), max(ys))):
                    ends[i] = v if ends[i] is None else (min if i < 2 else max)(ends[i], v)
                yield (geometry(self.srs, *place), *(r[n] if r[n] is None or isinstance(r[n], (int, float, str)) else str(r[n]) for n, _ in self.fields))

        n = db.executemany(put, made()).rowcount
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (self.table, self.table, *ends, self.srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (self.table, "POLYGON" if half == 2 else "POINT", self.srs))
        db.commit()
        db.close()
        if n <= 0 and number:  # only the first partition stands for an empty table
            os.remove(done.part)
            return Written("", "")
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.part:
                os.replace(m.part, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.part):
                os.remove(m.part)


class GeoPackage(DataSource):
    """Format `geopackage`, to write only: options path, table, srs."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), [(f.name, f.dataType.simpleString()) for f in schema.fields])


def write_geopackage(features: DataFrame, path: str, table: str, crs: str | None) -> None:
    """Writes features with a place (x, y, or corners x1, y1, x2, y2) as GeoPackages under a new path, a file for each partition; rows without a place are left out.

    `crs` is 'EPSG:<code>'; raises without one, since features in no place are worse than none, and if the path is there.
    """
    code = (crs or "").removeprefix("EPSG:")
    if not code.isdigit():
        raise ValueError(f"a CRS such as EPSG:4326 is needed, not {crs!r}")
    place = ["x1", "y1", "x2", "y2"] if "x1" in features.columns else ["x", "y"]
    if missing := [c for c in place if c not in features.columns]:
        raise ValueError(f"the features have no {', '.join(missing)}")
    if {"fid", "geom"} & {c.lower() for c in features.columns}:
        raise ValueError("fid and geom are the file's own columns")
    if os.path.exists(local(path)):
        raise ValueError(f"{path} is there")
    features.sparkSession.dataSource.register(GeoPackage)
    features.dropna(subset=place).write.format("geopackage").options(table=table, srs=code).mode("append").save(path)

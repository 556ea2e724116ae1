"""Features to vector files: data sources whose tasks write whole GeoPackages or shapefiles of their own, side by side in one
folder, as Spark does with tables.

A task stages its files under a folder of the job. The driver's commit gives them their names, after which readers see them;
abort removes the job's folder, so a failed job leaves nothing. A file takes at most `per_file` features, which bounds a
task's memory.

Columns: rings, else a box, else x and y, are the geometry; all others are attributes. Rows without a geometry (a null in its
columns, or no ring) have none in the file. An empty frame writes one empty file. Attributes that are neither numbers, truth
values nor text are written as JSON-like text.
"""

from __future__ import annotations

import datetime
import itertools
import sqlite3
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from canopyx.sources.tiff import place
from canopyx.sources.vector import WKB_MULTIPOLYGON, WKB_POINT, WKB_POLYGON
from canopyx.types import BOX, POINT

#: Features of one file at most.
PER_FILE = 100_000
#: Times that removing a job's folder is tried.
TRIES = 25

#: Fixed values of the formats: identifiers of a GeoPackage, kinds of shapes, lengths and types of fields.
APPLICATION, VERSION = 0x47504B47, 10300
SHP_FILE, SHP_VERSION, SHP_POINT, SHP_POLYGON = 9994, 1000, 1, 5
NAME_LENGTH, TEXT_LENGTH, NUMBER_LENGTH = 10, 254, 20
UNDEFINED = -1

Geometry = list[list[np.ndarray]] | tuple[float, ...] | None


def utm(epsg: int | None) -> str:
    """Well-known text of a UTM zone on WGS 84; empty for other codes."""
    if epsg is None or epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        return ""
    zone, south = epsg % 100, epsg // 100 == 327
    base = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    values = {"latitude_of_origin": 0, "central_meridian": 6 * zone - 183, "scale_factor": 0.9996, "false_easting": 500000, "false_northing": 10_000_000 if south else 0}
    return f'PROJCS["WGS 84 / UTM zone {zone}{"S" if south else "N"}",{base},PROJECTION["Transverse_Mercator"],' + ",".join(f'PARAMETER["{k}",{v}]' for k, v in values.items()) + f',UNIT["metre",1],AUTHORITY["EPSG","{epsg}"]]'


def closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def _turned(ring: np.ndarray, clockwise: bool) -> np.ndarray:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return ring[::-1] if ((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0) != clockwise else ring


class Shapes:
    """Geometries of a batch's rows."""

    def __init__(self, names: list[str]):
        self.kind = "rings" if "rings" in names else "box" if set(BOX) <= set(names) else "point"
        self.used = {"rings": ("rings",), "box": BOX, "point": POINT}[self.kind]
        if not set(self.used) <= set(names):
            raise ValueError(f"no geometry columns among {names}")

    def of(self, batch: pa.RecordBatch) -> Iterator[Geometry]:
        """Points and boxes as their coordinates."""
        columns = [batch.column(batch.schema.get_field_index(c)) for c in self.used]
        if self.kind != "rings":
            columns = [c.cast(pa.float64(), safe=False) for c in columns]
        for values in zip(*(c.to_pylist() for c in columns), strict=True):
            if None in values:
                yield None
            elif self.kind != "rings":
                yield values
            else:
                parts = [[closed(np.array([(v["x"], v["y"]) for v in ring], float)) for ring in part if ring] for part in values[0]]
                yield [p for p in parts if p] or None


def parts_of(shape: list[list[np.ndarray]] | tuple[float, float, float, float]) -> list[list[np.ndarray]]:
    if not isinstance(shape, tuple):
        return shape
    x0, y0, x1, y1 = shape
    return [[np.array([(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)])]]


def wkb(shape: list[list[np.ndarray]] | tuple[float, float], many: bool = False) -> bytes:
    """Well-known binary of a point or of parts; several parts are a multipolygon, or one where `many` asks for it."""
    if isinstance(shape, tuple):
        return struct.pack("<BI2d", 1, WKB_POINT, *shape)
    parts = [struct.pack("<BII", 1, WKB_POLYGON, len(part)) + b"".join(struct.pack("<I", len(r)) + r.astype("<f8").tobytes() for r in part) for part in shape]
    return parts[0] if len(parts) == 1 and not many else struct.pack("<BII", 1, WKB_MULTIPOLYGON, len(parts)) + b"".join(parts)


def _bounds(shape: list[list[np.ndarray]] | tuple[float, ...]) -> tuple[float, float, float, float]:
    if isinstance(shape, tuple):
        return (min(shape[0], shape[-2]), min(shape[1], shape[-1]), max(shape[0], shape[-2]), max(shape[1], shape[-1]))
    xy = np.concatenate([ring for part in shape for ring in part])
    return (*xy.min(axis=0).tolist(), *xy.max(axis=0).tolist())


#: A GeoPackage's geometry: its head with the bounds, and well-known binary of a point or of a polygon of one ring of five vertices.
_HEAD = [("magic", "S2"), ("version", "u1"), ("flags", "u1"), ("srs", "<i4"), ("bounds", "<f8", 4), ("order", "u1"), ("kind", "<u4")]
_POINT_BLOB, _BOX_BLOB = np.dtype([*_HEAD, ("xy", "<f8", 2)]), np.dtype([*_HEAD, ("rings", "<u4"), ("vertices", "<u4"), ("xy", "<f8", 10)])


def _blobs(shapes: list[tuple[float, ...] | None], kind: str, code: int) -> list[bytes | None]:
    """Geometries of points or boxes, made at once."""
    point = kind == "point"
    at = np.array([s for s in shapes if s is not None], float).reshape(-1, 2 if point else 4)
    rows = np.zeros(len(at), _POINT_BLOB if point else _BOX_BLOB)
    rows["magic"], rows["flags"], rows["srs"], rows["order"], rows["kind"] = b"GP", 3, code, 1, WKB_POINT if point else WKB_POLYGON
    rows["bounds"] = np.stack([np.minimum(at[:, 0], at[:, -2]), np.maximum(at[:, 0], at[:, -2]), np.minimum(at[:, 1], at[:, -1]), np.maximum(at[:, 1], at[:, -1])], axis=1)
    rows["xy"] = at if point else at[:, [0, 1, 0, 3, 2, 3, 2, 1, 0, 1]]
    if not point:
        rows["rings"], rows["vertices"] = 1, 5
    data, size = rows.tobytes(), rows.itemsize
    made = iter(range(0, len(data), size))
    return [None if s is None else data[k : k + size] for s in shapes for k in [0 if s is None else next(made)]]


def _plain(value):
    return value if value is None or isinstance(value, (int, float, str)) else str(value)


def geopackage(shapes: list[Geometry], attributes: dict[str, list], kind: str, table: str, epsg: int | None) -> dict[str, bytes]:
    """The file, by its ending."""
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    own = {c: v for c, v in attributes.items() if c.lower() not in ("fid", "geom")}  # names that the format gives
    own |= {f"{c}_": v for c, v in attributes.items() if c not in own}
    code = UNDEFINED if epsg is None else epsg
    affinity = lambda values: next(("REAL" if isinstance(v, float) else "INTEGER" if isinstance(v, int) else "TEXT" for v in values if v is not None), "TEXT")
    all_ = [_bounds(s) for s in shapes if s is not None]
    bounds = (*np.min(all_, axis=0)[:2].tolist(), *np.max(all_, axis=0)[2:].tolist()) if all_ else (None,) * 4
    db = sqlite3.connect(":memory:")
    db.execute(f"PRAGMA application_id = {APPLICATION}")
    db.execute(f"PRAGMA user_version = {VERSION}")
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
    systems = {-1: ("Undefined cartesian", "NONE", -1, "undefined"), 0: ("Undefined geographic", "NONE", 0, "undefined"), 4326: ("WGS 84", "EPSG", 4326, "undefined")}
    systems.setdefault(code, (f"EPSG:{code}", "EPSG", code, utm(code) or "undefined"))
    db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", [(name, k, by, n, text) for k, (name, by, n, text) in systems.items()])
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id))")
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', ?, ?, ?, ?, ?, ?)", (table, table, datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"), *bounds, code))
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
    form = "POINT" if kind == "point" else "POLYGON" if kind == "box" else "MULTIPOLYGON"
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (table, form, code))
    db.execute(f"CREATE TABLE {quoted(table)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom {form}" + "".join(f", {quoted(c)} {affinity(v)}" for c, v in own.items()) + ")")
    if kind == "rings":
        blobs = (None if s is None else struct.pack("<2sBBi4d", b"GP", 0, 3, code, b[0], b[2], b[1], b[3]) + wkb(s, True) for s in shapes for b in [s and _bounds(s)])
    else:
        blobs = _blobs(shapes, kind, code)
    db.executemany(f"INSERT INTO {quoted(table)} (geom{''.join(', ' + quoted(c) for c in own)}) VALUES (?{', ?' * len(own)})", zip(blobs, *(v if {type(x) for x in v} <= {int, float, str, type(None)} else map(_plain, v) for v in own.values()), strict=True))
    db.commit()
    data = db.serialize()
    db.close()
    return {".gpkg": data}


def _fields(attributes: dict[str, list]) -> tuple[bytes, list[tuple[int, list[bytes]]]]:
    """Field descriptors of a .dbf file, and each field's length and values."""
    heads, columns, taken = [], [], set()
    for name, values in attributes.items():
        raw = name.encode()[:NAME_LENGTH].decode(errors="ignore") or "field"
        k = 0
        while raw.lower() in taken:  # names of the first ten bytes may clash
            k += 1
            raw = name.encode()[: NAME_LENGTH - len(str(k))].decode(errors="ignore") + str(k)
        taken.add(raw.lower())
        known = [v for v in values if v is not None]
        if known and all(isinstance(v, bool) for v in known):
            code, texts, size = "L", [b"?" if v is None else b"T" if v else b"F" for v in values], 1
        elif known and all(isinstance(v, (int, float)) for v in known):
            code, texts = "F" if any(isinstance(v, float) for v in known) else "N", [b"" if v is None else repr(v).encode() for v in values]
            size = max(NUMBER_LENGTH, *map(len, texts))
        else:
            code, texts = "C", [b"" if v is None else str(v).encode()[:TEXT_LENGTH].decode(errors="ignore").encode() for v in values]
            size = max(1, *map(len, texts), 1)
        heads.append(struct.pack("<11sc4xBB14x", raw.encode(), code.encode(), size, 0))
        columns.append((size, [t.ljust(size) if code == "C" else t.rjust(size) for t in texts]))
    return b"".join(heads), columns


def shapefile(shapes: list[Geometry], attributes: dict[str, list], kind: str, table: str, epsg: int | None) -> dict[str, bytes]:
    """The files by their endings: shapes, their index, attributes, character set, and the projection where it is known."""
    code = SHP_POINT if kind == "point" else SHP_POLYGON
    body, index, at = [], [], 50
    for k, shape in enumerate(shapes, 1):
        if shape is None:
            data = struct.pack("<i", 0)
        elif kind == "point":
            data = struct.pack("<i2d", code, *shape)
        else:
            rings = [_turned(r, i == 0) for part in parts_of(shape) for i, r in enumerate(part)]
            starts = np.cumsum([0, *map(len, rings)])
            data = struct.pack("<i4d2i", code, *_bounds(shape), len(rings), starts[-1]) + starts[:-1].astype("<i4").tobytes() + np.concatenate(rings).astype("<f8").tobytes()
        body.append(struct.pack(">2i", k, len(data) // 2) + data)
        index.append(struct.pack(">2i", at, len(data) // 2))
        at += 4 + len(data) // 2
    known = [_bounds(s) for s in shapes if s is not None]
    bounds = (*np.min(known, axis=0)[:2], *np.max(known, axis=0)[2:]) if known else (0.0,) * 4
    head = lambda words: struct.pack(">i20xi", SHP_FILE, words) + struct.pack("<2i8d", SHP_VERSION, code, *bounds, 0, 0, 0, 0)
    fields, columns = _fields(attributes or {"id": list(range(1, len(shapes) + 1))})
    records = b"".join(b" " + b"".join(row) for row in zip(*(v for _, v in columns), strict=True))
    table_head = struct.pack("<4BIHH20x", 3, 95, 7, 26, len(shapes), 33 + len(fields), 1 + sum(s for s, _ in columns))
    files = {".shp": head(at) + b"".join(body), ".shx": head(50 + 4 * len(index)) + b"".join(index), ".dbf": table_head + fields + b"\r" + records + b"\x1a", ".cpg": b"UTF-8"}
    return files | ({".prj": utm(epsg).encode()} if utm(epsg) else {})


@dataclass
class Staged(WriterCommitMessage):
    """Names of a task's files in the job's folder."""

    files: list[str]


class FeatureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool, encode):
        self.path, self.table, self.overwrite, self.encode = options["path"].rstrip("/"), options.get("table", "features"), overwrite, encode
        self.epsg = int(options["epsg"]) if "epsg" in options else None
        self.per_file, self.job = int(options.get("per_file", PER_FILE)), uuid.uuid4().hex
        self.names = names
        Shapes(names)  # raises before any task runs
        if self.per_file < 1:
            raise ValueError("per_file must be at least 1")

    def _where(self) -> tuple[fs.FileSystem, str, str]:
        where, path = place(self.path)
        return where, path, f"{path}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        where, _, staging = self._where()
        where.create_dir(staging, recursive=True)
        context, shapes = TaskContext.get(), Shapes(self.names)
        # of two attempts at a task only the one that reports is committed
        stem = f"part-{context.partitionId():05d}-{self.job[:8]}-{context.taskAttemptId()}"
        done: list[str] = []
        flushes = itertools.count()
        rows: list[Geometry] = []
        held: dict[str, list] = {c: [] for c in self.names if c != "rings"}

        def flush() -> None:
            number = next(flushes)
            for end, data in self.encode(rows, held, shapes.kind, self.table, self.epsg).items():
                name = f"{stem}-{number}{end}"
                with where.open_output_stream(f"{staging}/{name}") as out:
                    out.write(data)
                done.append(name)
            rows.clear()
            for v in held.values():
                v.clear()

        for batch in iterator:
            for start in range(0, batch.num_rows, self.per_file):
                part = batch.slice(start, self.per_file)
                while part.num_rows:
                    some = part.slice(0, self.per_file - len(rows))
                    part = part.slice(some.num_rows)
                    rows += shapes.of(some)
                    for c, values in held.items():
                        values += some.column(some.schema.get_field_index(c)).to_pylist()
                    if len(rows) == self.per_file:
                        flush()
        if rows or not done and context.partitionId() == 0:
            flush()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        where, path, staging = self._where()
        old = [f.path for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File] if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                where.move(f"{staging}/{name}", f"{path}/{name}")
        for file in old:
            where.delete_file(file)
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        where, _, staging = self._where()
        for left in range(TRIES, 0, -1):
            if where.get_file_info(staging).type != fs.FileType.Directory:
                return
            try:
                where.delete_dir(staging)
            except OSError:  # a task of a failed job may still be writing into it
                if left == 1:
                    raise
                time.sleep(0.2)


class _Sink(DataSource):
    encode = None

    def schema(self):
        raise NotImplementedError("read the files with canopyx.sources.vector")

    def writer(self, schema: T.StructType, overwrite: bool) -> FeatureWriter:
        return FeatureWriter(dict(self.options), schema.fieldNames(), overwrite, type(self).encode)


class GeoPackages(_Sink):
    """df.write.format("geopackages").save(folder). Options: table, epsg, per_file."""

    encode = staticmethod(geopackage)

    @classmethod
    def name(cls) -> str:
        return "geopackages"


class Shapefiles(_Sink):
    """df.write.format("shapefiles").save(folder). Options: epsg, per_file. Text over 254 bytes is cut, as the format has it."""

    encode = staticmethod(shapefile)

    @classmethod
    def name(cls) -> str:
        return "shapefiles"


def write_features(df: DataFrame, path: str, kind: str = "geopackages", epsg: int | None = None, mode: str = "append", per_file: int = PER_FILE) -> None:
    """df's rows as vector files in a folder: geopackages or shapefiles."""
    for source in (GeoPackages, Shapefiles):
        df.sparkSession.dataSource.register(source)
    options = {"per_file": str(per_file)} | ({"epsg": str(epsg)} if epsg is not None else {})
    df.write.format(kind).mode(mode).options(**options).save(path)

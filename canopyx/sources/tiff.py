"""Large rasters by blocks: TIFF and BigTIFF files whose pixels lie in tiles or strips.

A task reads a file's directory and then only the byte ranges of the blocks that it needs, so no raster is ever whole in
memory. Blocks are plain, deflated or Zstandard, with or without horizontal differences, bands interleaved or in planes.
`raster_blocks` is a data source whose partitions are runs of blocks; read_windows() sends windows to tasks by the part of
the image that they lie in and cuts them out of a bounded cache of blocks, so pixels are never shuffled.

Files are opened by pyarrow's file systems: a local or mounted path, or any store that they know.
"""

from __future__ import annotations

import io
import itertools
import json
import struct
import tempfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from canopyx.functions import boxes
from canopyx.sources.rasters import CROP

#: Fixed values of the format: tags, their types' sizes, compressions, geographic keys.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS, STRIP_BYTES, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLES = 322, 323, 324, 325, 339
COLOURS, SCALE, TIE, GEO_KEYS = 262, 33550, 33922, 34735
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATE, ZSTANDARD = 1, (8, 32946), 50000
KINDS = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC, PROJECTED = 2048, 3072

#: Decoded blocks that a task keeps, and pixels of the side of the part of an image whose windows go to one task.
CACHE_BYTES, PART = 128 << 20, 4096
#: Entries of a block table read at a time, and bytes between blocks that are read along.
ENTRIES, GAP = 8192, 512
#: Bytes of blocks of a partition, and of pixels of one batch.
RUN_BYTES, BATCH_BYTES = 64 << 20, 8 << 20

Read = Callable[[int, int], bytes]


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def save(file: io.IOBase, where: fs.FileSystem, path: str) -> None:
    """Copies an open file to a path, which appears when all is there."""
    file.seek(0)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as out:
        while data := file.read(8 << 20):
            out.write(data)
    where.move(part, path)


@dataclass(frozen=True)
class Layout:
    """What a file's first directory says. offsets and sizes: place, entry type and count of the tables of blocks."""

    width: int
    height: int
    block_w: int
    block_h: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    planes: bool
    tiled: bool
    order: str
    offsets: tuple[int, int, int]
    sizes: tuple[int, int, int]
    left: float | None = None
    top: float | None = None
    res: float | None = None
    epsg: int | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_h)

    @property
    def blocks(self) -> int:
        """Of one plane, or of all bands where they are interleaved."""
        return self.across * self.down


class File:
    """Random reads of one file; counts the bytes."""

    def __init__(self, path: str):
        where, at = place(path)
        self._file, self.bytes = where.open_input_file(at), 0

    def __call__(self, at: int, size: int) -> bytes:
        got = self._file.read_at(size, at)
        self.bytes += len(got)
        return got


def read_layout(read: Read) -> Layout:
    """The first directory of a file, from a few small reads."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(f"{order}Q", head, 8)[0] if big else struct.unpack_from(f"{order}I", head, 4)[0]
    count_size, entry, value_size, value_code = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    (n,) = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, count_size))
    raw = read(at + count_size, n * entry)
    tags: dict[int, tuple[int, int, int]] = {}
    for k in range(n):
        tag, kind = struct.unpack_from(f"{order}2H", raw, k * entry)
        (count,) = struct.unpack_from(f"{order}{value_code}", raw, k * entry + 4)
        inline = at + count_size + k * entry + entry - value_size
        place = inline if SIZES.get(kind, 1) * count <= value_size else struct.unpack_from(f"{order}{value_code}", raw, k * entry + entry - value_size)[0]
        tags[tag] = (place, kind, count)

    def values(tag: int, default: tuple = ()) -> tuple:
        if tag not in tags:
            return default
        place, kind, count = tags[tag]
        return struct.unpack(f"{order}{count}{CODES[kind]}", read(place, SIZES[kind] * count))

    one = lambda tag, default: values(tag, (default,))[0]
    width, height, bits = one(WIDTH, 0), one(HEIGHT, 0), values(BITS, (1,))
    tiled = TILES in tags
    if not tiled and STRIPS not in tags or min(width, height) < 1:
        raise ValueError("a TIFF file without pixels")
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits are not supported")
    if one(COMPRESSION, PLAIN) not in (PLAIN, *DEFLATE, ZSTANDARD):
        raise ValueError(f"compression {one(COMPRESSION, PLAIN)} is not supported")
    if one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"predictor {one(PREDICTOR, 1)} is not supported")
    keys = values(GEO_KEYS)
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    scale, tie = values(SCALE), values(TIE)
    geo = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0]) if len(scale) > 1 and len(tie) > 5 else (None,) * 3
    block = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    dtype = f"{order}{KINDS[one(SAMPLES, 1)]}{bits[0] // 8}"
    return Layout(width, height, *block, one(BANDS, 1), dtype, one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANES, 1) == 2, tiled, order, tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], *geo, codes.get(PROJECTED, codes.get(GEOGRAPHIC)))


def decode(data: bytes, layout: Layout, rows: int | None = None) -> np.ndarray:
    """A block's pixels, rows x columns x bands (one band where they lie in planes)."""
    bands, rows = 1 if layout.planes else layout.bands, rows or layout.block_h
    if not data:  # a block that was never written
        return np.zeros((rows, layout.block_w, bands), layout.dtype)
    if layout.compression in DEFLATE:
        data = zlib.decompress(data)
    elif layout.compression == ZSTANDARD:
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    out = np.frombuffer(data, layout.dtype, rows * layout.block_w * bands).reshape(rows, layout.block_w, bands)
    return np.cumsum(out, axis=1, dtype=out.dtype) if layout.predictor == 2 else out


class Raster:
    """Blocks of one file, the last used ones kept."""

    def __init__(self, path: str, keep: int = CACHE_BYTES):
        self.read = File(path)
        self.layout = read_layout(self.read)
        self.keep, self.held = keep, 0
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()
        self.tables: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _entries(self, table: tuple[int, int, int], blocks: np.ndarray) -> np.ndarray:
        """Values of a table of blocks, read by pieces."""
        place, kind, count = table
        out = np.zeros(len(blocks), np.int64)
        for piece in np.unique(blocks // ENTRIES).tolist():
            if (place, piece) not in self.tables:
                n = min(ENTRIES, count - piece * ENTRIES)
                self.tables[place, piece] = np.frombuffer(self.read(place + piece * ENTRIES * SIZES[kind], n * SIZES[kind]), self.layout.order + CODES[kind])
                if len(self.tables) > 64:
                    self.tables.popitem(last=False)
            own = blocks // ENTRIES == piece
            out[own] = self.tables[place, piece][blocks[own] % ENTRIES]
        return out

    def places(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and sizes of blocks."""
        return self._entries(self.layout.offsets, blocks), self._entries(self.layout.sizes, blocks)

    def fetch(self, blocks: list[int]) -> dict[int, np.ndarray]:
        """The pixels of blocks; those that lie side by side come by one read."""
        out = {b: self.cache[b] for b in blocks if b in self.cache}
        for b in out:
            self.cache.move_to_end(b)
        missing = np.array([b for b in blocks if b not in out], np.int64)
        if len(missing):
            offsets, sizes = self.places(missing)
            order = np.argsort(offsets, kind="stable")
            start = 0
            for k in range(1, len(order) + 1):
                last = order[k - 1]
                if k == len(order) or not -1 < offsets[order[k]] - (offsets[last] + sizes[last]) <= GAP:
                    run = order[start:k]
                    base = int(offsets[run[0]])
                    stop = int((offsets[run] + sizes[run]).max())
                    data = self.read(base, stop - base) if sizes[run].any() else b""
                    for i in run:
                        at = int(offsets[i]) - base
                        out[int(missing[i])] = self._keep(int(missing[i]), decode(data[at : at + int(sizes[i])], self.layout, self._rows(int(missing[i]))))
                    start = k
        return out

    def _rows(self, block: int) -> int:
        """Rows that a block holds: tiles are whole, the last strip may be shorter."""
        row = block % self.layout.blocks // self.layout.across
        return self.layout.block_h if self.layout.tiled else min(self.layout.block_h, self.layout.height - row * self.layout.block_h)

    def _keep(self, block: int, pixels: np.ndarray) -> np.ndarray:
        self.cache[block] = pixels
        self.held += pixels.nbytes
        while self.held > self.keep and len(self.cache) > 1:
            self.held -= self.cache.popitem(last=False)[1].nbytes
        return pixels

    def window(self, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Bands x rows x columns; zero beyond the raster. Blocks come row by row of blocks, so a window of any width takes
        its own pixels and a row of blocks."""
        a = self.layout
        out = np.zeros((a.bands, h, w), a.dtype)
        x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, a.width), min(y + h, a.height)
        if x0 >= x1 or y0 >= y1:
            return out
        columns = range(x0 // a.block_w, (x1 - 1) // a.block_w + 1)
        for plane in range(a.bands if a.planes else 1):
            for row in range(y0 // a.block_h, (y1 - 1) // a.block_h + 1):
                got = self.fetch([plane * a.blocks + row * a.across + c for c in columns])
                top, bottom = max(y0, row * a.block_h), min(y1, (row + 1) * a.block_h)
                for c in columns:
                    left, right = max(x0, c * a.block_w), min(x1, (c + 1) * a.block_w)
                    pixels = got[plane * a.blocks + row * a.across + c][top - row * a.block_h : bottom - row * a.block_h, left - c * a.block_w : right - c * a.block_w]
                    out[plane : plane + 1 if a.planes else None, top - y : bottom - y, left - x : right - x] = pixels.transpose(2, 0, 1)
        return out


class Writer:
    """A tiled raster, block by block in any order; blocks that are left out are zeros and take no bytes. The directory
    follows the blocks, so nothing but its tables is held; the header is written last, so out must be seekable."""

    def __init__(self, out: io.RawIOBase, width: int, height: int, bands: int, dtype: str, block: int = 256, compress: bool = True, predictor: bool = False, big: bool = False, geo: tuple[float, float, float] | None = None, epsg: int | None = None):
        self.out, self.size, self.bands, self.block, self.compress, self.predictor, self.big, self.geo, self.epsg = out, (width, height), bands, block, compress, predictor, big, geo, epsg
        self.kind = np.dtype(dtype).newbyteorder("<")
        self.across = -(-width // block)
        self.offsets, self.sizes = (np.zeros(self.across * -(-height // block), np.uint64) for _ in "os")
        self.at = out.write(b"\0" * 16)

    def encoded(self, pixels: np.ndarray) -> bytes:
        """A block of rows x columns x bands, filled up with zeros."""
        whole = np.zeros((self.block, self.block, self.bands), self.kind)
        whole[: pixels.shape[0], : pixels.shape[1]] = pixels
        if self.predictor:
            whole[:, 1:] = np.diff(whole, axis=1)
        return zlib.compress(whole.tobytes()) if self.compress else whole.tobytes()

    def add(self, row: int, column: int, data: bytes) -> None:
        k = row * self.across + column
        self.offsets[k], self.sizes[k] = self.at, len(data)
        self.at += self.out.write(data)

    def close(self) -> None:
        word, (code, inline) = (16, ("Q", 8)) if self.big else (4, ("I", 4))
        if self.at >= 1 << 32 and not self.big:
            raise ValueError("a file over 4 GiB must be a BigTIFF")
        tags = [(WIDTH, 4, self.size[:1]), (HEIGHT, 4, self.size[1:]), (BITS, 3, [8 * self.kind.itemsize] * self.bands), (COMPRESSION, 3, [DEFLATE[0] if self.compress else PLAIN]), (COLOURS, 3, [2 if self.bands == 3 else 1]), (BANDS, 3, [self.bands]), (PLANES, 3, [1]), (PREDICTOR, 3, [2 if self.predictor else 1])]
        tags += [(TILE_WIDTH, 4, [self.block]), (TILE_HEIGHT, 4, [self.block]), (TILES, word, self.offsets), (TILE_BYTES, word, self.sizes), (SAMPLES, 3, [next(k for k, v in KINDS.items() if v == self.kind.kind)] * self.bands)]
        if self.geo:
            left, top, res = self.geo
            tags += [(SCALE, 12, [res, res, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, left, top, 0.0])]
        if self.epsg:
            tags.append((GEO_KEYS, 3, [1, 1, 0, 1, PROJECTED, 0, 1, self.epsg]))
        entries = []
        for tag, kind, values in sorted(tags, key=lambda t: t[0]):
            data = np.asarray(values).astype(np.dtype(CODES[kind]).newbyteorder("<")).tobytes()
            if len(data) > inline:
                place = self.at
                self.at += self.out.write(data)
                data = struct.pack(f"<{code}", place)
            entries.append(struct.pack(f"<HH{code}", tag, kind, len(values)) + data.ljust(inline, b"\0"))
        self.out.write(struct.pack("<Q" if self.big else "<H", len(entries)) + b"".join(entries) + b"\0" * inline)
        self.out.seek(0)
        self.out.write(struct.pack("<2s3HQ", b"II", 43, 8, 0, self.at) if self.big else struct.pack("<2sHI8x", b"II", 42, self.at))


def encode(pixels: np.ndarray, block: int = 256, **options) -> bytes:
    """The bytes of a tiled raster of rows x columns x bands."""
    out = io.BytesIO()
    w = Writer(out, pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels.dtype.str, block, **options)
    for row in range(0, pixels.shape[0], block):
        for column in range(0, pixels.shape[1], block):
            w.add(row // block, column // block, w.encoded(pixels[row : row + block, column : column + block]))
    w.close()
    return out.getvalue()


_LAYOUT = "image_path string, path string, width int, height int, block_w int, block_h int, bands int, dtype string, tiled boolean, left double, top double, res double, epsg int"
_LAYOUT_NAMES = [c.split()[0] for c in _LAYOUT.split(", ")]


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """image_path, path, size, blocks, georeference (null without one) and EPSG code of each .tif or .tiff file; reads directories only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, at in zip(frame["image_path"], frame["path"], strict=True):
                layout = read_layout(File(at))
                rows.append((name, at, *(getattr(layout, c) for c in _LAYOUT_NAMES[2:])))
            yield pd.DataFrame(rows, columns=_LAYOUT_NAMES).astype({"epsg": "Int64"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path")
    return found.withColumn("image_path", boxes.basename(F.col("path"))).mapInPandas(run, _LAYOUT)


WINDOW_PIXELS = "image_path string, window_index long, window_xmin int, window_ymin int, window_w int, window_h int, bands int, dtype string, pixels binary"


def read_windows(spark: SparkSession, path: str, windows: DataFrame, counter=None) -> DataFrame:
    """The samples of each window (image_path, window_index, window_xmin, window_ymin, window_w, window_h), bands x rows x
    columns as they are in the file; zero beyond the raster. Rasters whose pixels are not in tiles raise.

    Windows of one PART of an image go to one task, which reads each block of it once; neighbouring parts share the blocks on
    their border. counter: an accumulator that gets the number of bytes read.
    """
    names = [c.split()[0] for c in WINDOW_PIXELS.split(", ")]
    files = layouts(spark, path).select("image_path", "path", F.when(F.col("tiled"), F.col("tiled")).otherwise(F.raise_error(F.concat("image_path", F.lit(": the raster is not tiled"))).cast("boolean")).alias("tiled"))
    at = windows.select("image_path", F.col("window_index").cast("long").alias("window_index"), *(F.col(c).cast("int").alias(c) for c in names[2:6])).join(files, "image_path").where("tiled")
    part = [F.floor(F.col(c) / PART).alias(f"_{c[7]}") for c in ("window_ymin", "window_xmin")]
    dealt = at.select("path", *names[:6], *part).repartition("path", "_y", "_x").sortWithinPartitions("path", "_y", "_x", "window_ymin", "window_xmin").drop("_y", "_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raster, now, seen = None, None, 0
        schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in WINDOW_PIXELS.split(", "))])
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for file, *window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    raster, now, seen = Raster(file), file, 0
                pixels = raster.window(*window[2:6])
                rows.append((*window, raster.layout.bands, raster.layout.dtype, pixels.tobytes()))
                size += pixels.nbytes
                if counter is not None:
                    counter.add(raster.read.bytes - seen)
                    seen = raster.read.bytes
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, WINDOW_PIXELS)


def band_sums(rows: DataFrame) -> DataFrame:
    """rows (of read_windows() or raster_blocks) with total, the sum of their samples, in place of the pixels."""
    names = [c for c in rows.columns if c != "pixels"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[names].assign(total=[float(np.frombuffer(p, d).sum(dtype=np.float64)) for p, d in zip(frame["pixels"], frame["dtype"], strict=True)])

    return rows.mapInPandas(run, T.StructType([rows.schema[c] for c in names] + [T.StructField("total", T.DoubleType())]))


def crops(spark: SparkSession, path: str, windows: DataFrame, counter=None) -> DataFrame:
    """As rasters.crops(), from tiled rasters of three bands, whose values are divided by 255."""
    columns = [c.split()[0] for c in CROP.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.bands != 3:
                    raise ValueError(f"{row.image_path}: an image needs three channels, not {row.bands}")
                yield pd.DataFrame([(*row[:6], np.frombuffer(row.pixels, row.dtype).astype(np.float32) / 255)], columns=columns)

    return read_windows(spark, path, windows, counter).mapInPandas(run, CROP)


@dataclass
class Run(InputPartition):
    """Blocks first to last of a file, one after another."""

    path: str
    first: int
    last: int

    def __post_init__(self):
        self.value = (self.path, self.first, self.last)


class BlockReader(DataSourceReader):
    """Plans runs of blocks from directories alone."""

    def __init__(self, options: dict[str, str]):
        self.path, self.run_bytes = options["path"], int(options.get("run_bytes", RUN_BYTES))
        self.names = set(json.loads(options["images"])) if "images" in options else None
        self.bounds = {axis: json.loads(options.get(axis, "[null, null]")) for axis in "xy"}

    def _span(self, axis: str, size: int, count: int) -> range:
        """Blocks along an axis that touch the pixels from the lower bound to below the upper one."""
        low, high = self.bounds[axis]
        return range(0 if low is None else max(0, low // size), count if high is None else max(0, min(count, -(-high // size))))

    def partitions(self):
        where, at = place(self.path)
        info = where.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=False))
        head = self.path[: self.path.find("://") + 3] if "://" in self.path else ""
        out = []
        for f in sorted((f for f in files if f.path.lower().endswith((".tif", ".tiff"))), key=lambda f: f.path):
            if self.names is not None and f.base_name not in self.names:
                continue
            path = head + f.path
            a = read_layout(File(path))
            each = max(1, self.run_bytes // (a.block_w * a.block_h * a.bands * np.dtype(a.dtype).itemsize))
            columns = self._span("x", a.block_w, a.across)
            whole = len(columns) == a.across
            for row in self._span("y", a.block_h, a.down):
                first = row * a.across + columns.start
                for start in range(first, first + len(columns), each):
                    stop = min(start + each, first + len(columns))
                    if whole and out and out[-1].path == path and out[-1].last == start and stop - out[-1].first <= each:
                        out[-1] = Run(path, out[-1].first, stop)
                    else:
                        out.append(Run(path, start, stop))
        return out

    def read(self, partition: Run | None):
        if partition is None:  # Spark asks so where nothing is planned
            return
        raster = Raster(partition.path, keep=0)
        a = raster.layout
        name = partition.path.rsplit("/", 1)[-1]
        for k in range(partition.first, partition.last):
            y, x = (n * s for n, s in zip(divmod(k, a.across), (a.block_h, a.block_w), strict=True))
            w, h = min(a.block_w, a.width - x), min(a.block_h, a.height - y)
            yield name, k, x, y, w, h, a.bands, a.dtype, raster.window(x, y, w, h).tobytes()


class RasterBlocks(DataSource):
    """spark.read.format("raster_blocks").load(path): a row for each block, cut at the raster's border, its pixels as bands x
    rows x columns. Options: run_bytes, the decoded bytes of a partition at most; images, a JSON list of file names; x and y,
    JSON lists of two, the range of pixels whose blocks are read (null: no bound).

    These are options and not pushed filters since PySpark 4.1.2 keeps a plan with the loaded frame: its next use, with
    other filters or none, would read what the first one asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return "image_path string, block int, x int, y int, width int, height int, bands int, dtype string, pixels binary"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def blocks(spark: SparkSession, path: str, images: list[str] | None = None, x: tuple[int | None, int | None] = (None, None), y: tuple[int | None, int | None] = (None, None), run_bytes: int = RUN_BYTES) -> DataFrame:
    """raster_blocks of a folder or file; only of some images, or of those blocks that touch a range of columns and rows."""
    spark.dataSource.register(RasterBlocks)
    some = {"run_bytes": str(run_bytes), "x": json.dumps(x), "y": json.dumps(y)} | ({"images": json.dumps(images)} if images is not None else {})
    return spark.read.format("raster_blocks").options(**some).load(path)


def write_points(points: DataFrame, images: DataFrame, path: str, block: int = 256) -> None:
    """A one-band raster of 16 bits, `image_path`.tif, for each image (image_path, width, height, left, top, res), whose cells
    count the points (image_path, x, y) in them, up to 65535. Points outside are left out.

    Points meet by block, and each block is encoded where it is counted; the encoded blocks of an image are put into its file
    by one task, which holds one of them at a time. A file takes its name when it is whole.
    """
    sized = points.select("image_path", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).join(images.select("image_path", "width", "height"), "image_path")
    cells = sized.where("x >= 0 and x < width and y >= 0 and y < height").groupBy("image_path", "x", "y").agg(F.count("*").alias("n"))
    cells = cells.select("image_path", F.floor(F.col("y") / block).cast("int").alias("row"), F.floor(F.col("x") / block).cast("int").alias("column"), (F.col("x") % block).alias("x"), (F.col("y") % block).alias("y"), F.least("n", F.lit(65535)).alias("n"))

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        pixels = np.zeros((block, block), "<u2")
        pixels[frame["y"], frame["x"]] = frame["n"]
        return pd.DataFrame({"image_path": [key[0]], "row": [key[1]], "column": [key[2]], "data": [zlib.compress(pixels.tobytes())]})

    packed = cells.groupBy("image_path", "row", "column").applyInPandas(pack, "image_path string, row int, column int, data binary")
    names = ("width", "height", "left", "top", "res")
    head = images.select("image_path", F.lit(-1).alias("row"), F.lit(-1).alias("column"), F.lit(None).cast("binary").alias("data"), *names)
    rows = head.unionByName(packed, allowMissingColumns=True).repartition("image_path").sortWithinPartitions("image_path", "row", "column")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, at = place(path)
        where.create_dir(at, recursive=True)
        stored = (r for frame in frames for r in frame.itertuples(index=False))
        for image, own in itertools.groupby(stored, key=lambda r: r.image_path):
            with tempfile.TemporaryFile() as out:  # of this task alone
                first = next(own)
                w = Writer(out, int(first.width), int(first.height), 1, "<u2", block, geo=(first.left, first.top, first.res))
                for r in own:
                    w.add(r.row, r.column, r.data)
                w.close()
                save(out, where, f"{at}/{image}.tif")
        yield pd.DataFrame({"done": [1]})

    rows.mapInPandas(put, "done int").count()

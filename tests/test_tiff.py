"""Rasters by blocks: directories, decoding, windows, what is read, and the data source."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyx.sources import rasters, tiff


def picture(width, height, bands=3, dtype="<u1", seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 200, (height, width, bands)).astype(dtype)


def by_hand(pixels, order="<", planes=False, strip=None, big=False):
    """A file written plainly, in either byte order, with strips or planes, to hold the reader against."""
    h, w, bands = pixels.shape
    kind = pixels.dtype.newbyteorder(order)
    block_w, block_h = (w, strip) if strip else (32, 16)
    blocks = []
    for layer in [pixels[:, :, [k]] for k in range(bands)] if planes else [pixels]:
        for y in range(0, h, block_h):
            for x in range(0, w, block_w):
                own = layer[y : y + block_h, x : x + block_w]
                if not strip:
                    whole = np.zeros((block_h, block_w, own.shape[2]), kind)
                    whole[: own.shape[0], : own.shape[1]] = own
                    own = whole
                blocks.append(np.ascontiguousarray(own.astype(kind)).tobytes())
    data, offsets = b"\0" * 16, []
    for b in blocks:
        offsets.append(len(data))
        data += b
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * kind.itemsize] * bands), (259, "H", [1]), (277, "H", [bands]), (284, "H", [2 if planes else 1])]
    tags += [(273, "I", offsets), (278, "H", [strip]), (279, "I", [len(b) for b in blocks])] if strip else [(322, "H", [block_w]), (323, "H", [block_h]), (324, "I", offsets), (325, "I", [len(b) for b in blocks])]
    code, inline = ("Q", 8) if big else ("I", 4)
    entries = b""
    for tag, letter, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(raw) > inline:
            raw, data = struct.pack(f"{order}{code}", len(data)), data + raw
        entries += struct.pack(f"{order}HH{code}", tag, {"H": 3, "I": 4}[letter], len(values)) + raw.ljust(inline, b"\0")
    at = len(data)
    data += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * inline
    mark = b"II" if order == "<" else b"MM"
    head = struct.pack(f"{order}2s3HQ", mark, 43, 8, 0, at) if big else struct.pack(f"{order}2sHI", mark, 42, at)
    return head.ljust(16, b"\0") + data[16:]


def cut(pixels, x, y, w, h):
    out = np.zeros((pixels.shape[2], h, w), pixels.dtype)
    part = pixels[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)].transpose(2, 0, 1)
    out[:, max(0, -y) : max(0, -y) + part.shape[1], max(0, -x) : max(0, -x) + part.shape[2]] = part
    return out


WINDOWS = [(0, 0, 10, 10), (5, 7, 60, 50), (-4, -3, 20, 20), (90, 60, 40, 40), (0, 0, 97, 71), (200, 0, 5, 5), (31, 15, 2, 2), (-50, -50, 10, 10)]


@pytest.mark.parametrize("dtype", ["<u1", "<u2", "<i2", "<f4", "<f8"])
@pytest.mark.parametrize("options", [{}, {"compress": False}, {"predictor": True}, {"big": True}])
def test_windows_of_encoded(tmp_path, dtype, options):
    if options.get("predictor") and dtype[1] == "f":
        return
    pixels = picture(97, 71, 3, dtype)
    (tmp_path / "a.tif").write_bytes(tiff.encode(pixels, 32, geo=(10.0, 20.0, 0.5), epsg=32617, **options))
    raster = tiff.Raster(str(tmp_path / "a.tif"))
    assert (raster.layout.left, raster.layout.top, raster.layout.res, raster.layout.epsg) == (10.0, 20.0, 0.5, 32617)
    for window in WINDOWS:
        assert (raster.window(*window) == cut(pixels, *window)).all()


@pytest.mark.parametrize("options", [{}, {"order": ">"}, {"planes": True}, {"strip": 10}, {"strip": 10, "planes": True}, {"big": True, "order": ">"}])
def test_windows_by_hand(tmp_path, options):
    pixels = picture(97, 71, 2, "<u2")
    (tmp_path / "a.tif").write_bytes(by_hand(pixels, **options))
    raster = tiff.Raster(str(tmp_path / "a.tif"), keep=1000)
    assert raster.layout.tiled == ("strip" not in options)
    for window in WINDOWS:
        assert (raster.window(*window) == cut(pixels, *window)).all()


def test_odd_files():
    ok = tiff.encode(picture(8, 8), 16)
    for data in (b"", b"P6 1 1 255\n", ok[:30], b"II*\0" + b"\xff" * 12):
        with pytest.raises((ValueError, struct.error)):
            tiff.read_layout(lambda at, size, data=data: data[at : at + size])
    tag = struct.pack("<HHI", 259, 3, 1)
    with pytest.raises(ValueError, match="compression 5"):
        data = ok.replace(tag + struct.pack("<I", 8), tag + struct.pack("<I", 5))
        tiff.read_layout(lambda at, size: data[at : at + size])


def windows(spark, rows):
    return spark.createDataFrame(rows, "image_path string, window_index int, window_xmin int, window_ymin int, window_w int, window_h int")


def test_crops_equal_whole_files(spark, tmp_path):
    """The same crops as from whole images in another format."""
    asked = []
    for k, size in enumerate([(97, 71), (200, 40), (64, 64)]):
        pixels = picture(*size, seed=k)
        (tmp_path / f"i{k}.tif").write_bytes(tiff.encode(pixels, 32, predictor=bool(k)))
        (tmp_path / f"i{k}.ppm").write_bytes(f"P6 {size[0]} {size[1]} 255\n".encode() + pixels.tobytes())
        asked += [(f"i{k}", i, *w) for i, w in enumerate(WINDOWS[:5])]
    ours = tiff.crops(spark, str(tmp_path), windows(spark, [(f"{n}.tif", *r) for n, *r in asked]))
    whole = rasters.crops(spark, f"{tmp_path}/*.ppm", windows(spark, [(f"{n}.ppm", *r) for n, *r in asked]))
    found, expected = ({(r["image_path"][:2], r["window_index"]): (r["window_xmin"], r["window_w"], r["pixels"]) for r in d.collect()} for d in (ours, whole))
    assert found == expected and len(found) == len(asked)


def test_strips_and_bands(spark, tmp_path):
    (tmp_path / "s.tif").write_bytes(by_hand(picture(20, 20), strip=5))
    with pytest.raises(Exception, match="not tiled"):
        tiff.read_windows(spark, str(tmp_path), windows(spark, [("s.tif", 0, 0, 0, 5, 5)])).collect()
    (tmp_path / "s.tif").write_bytes(tiff.encode(picture(20, 20, 1), 16))
    with pytest.raises(Exception, match="three channels"):
        tiff.crops(spark, str(tmp_path), windows(spark, [("s.tif", 0, 0, 0, 5, 5)])).collect()
    assert tiff.read_windows(spark, str(tmp_path), windows(spark, [("other.tif", 0, 0, 0, 5, 5)])).count() == 0


def huge(path, side=200_000, block=512):
    """A raster of 120 GB of pixels of which six blocks are there; the others take no bytes."""
    known = {(r, c): picture(block, block, seed=r * 1000 + c) for r, c in [(0, 0), (0, 1), (1, 0), (200, 300), (390, 390), (390, 389)]}
    with open(path, "wb") as out:
        w = tiff.Writer(out, side, side, 3, "<u1", block, big=True)
        for (r, c), pixels in known.items():
            w.add(r, c, w.encoded(pixels))
        w.close()
    return known


def test_larger_than_memory(spark, tmp_path):
    known = huge(tmp_path / "huge.tif")
    rows = [("huge.tif", 0, 300, 300, 400, 400), ("huge.tif", 1, 300 * 512 + 10, 200 * 512 + 20, 50, 60), ("huge.tif", 2, 199_999, 199_999, 4, 4), ("huge.tif", 3, 100_000, 50_000, 300, 300)]
    counter = spark.sparkContext.accumulator(0)
    found = {r["window_index"]: np.frombuffer(r["pixels"], r["dtype"]).reshape(r["bands"], r["window_h"], r["window_w"]) for r in tiff.read_windows(spark, str(tmp_path), windows(spark, rows), counter).collect()}
    assert (found[1] == known[200, 300][20:80, 10:60].transpose(2, 0, 1)).all()
    quad = np.zeros((1024, 1024, 3), "u1")
    for (r, c), pixels in known.items():
        if r < 2 and c < 2:
            quad[r * 512 : (r + 1) * 512, c * 512 : (c + 1) * 512] = pixels
    assert (found[0] == quad[300:700, 300:700].transpose(2, 0, 1)).all()
    assert found[2][:, :1, :1].shape == (3, 1, 1) and not found[3].any() and not found[2][:, 1:].any()
    touched = sum(len(zlib.compress(known[k].tobytes())) for k in [(0, 0), (0, 1), (1, 0), (200, 300), (390, 390)])
    # the blocks asked for, the pieces of the tables that list them, and directories
    assert counter.value <= touched + 4 * 2 * tiff.ENTRIES * 8 + 8 * 4096 < (tmp_path / "huge.tif").stat().st_size


def test_block_once_for_many_windows(spark, tmp_path):
    """Overlapping windows of one part of an image read each block once."""
    pixels = picture(640, 640)
    (tmp_path / "a.tif").write_bytes(tiff.encode(pixels, 64, compress=False))
    rows = [("a.tif", k, x, y, 100, 100) for k, (x, y) in enumerate((x, y) for x in range(0, 640, 40) for y in range(0, 640, 40))]
    counter = spark.sparkContext.accumulator(0)
    assert tiff.read_windows(spark, str(tmp_path), windows(spark, rows), counter).count() == len(rows)
    assert 640 * 640 * 3 <= counter.value <= 640 * 640 * 3 + 8192


def test_data_source(spark, tmp_path):
    all_ = {f"p{k}.tif": picture(100 + k, 70, 2, "<u2", k) for k in range(3)}
    for name, pixels in all_.items():
        (tmp_path / name).write_bytes(tiff.encode(pixels, 32))
    rows = tiff.blocks(spark, str(tmp_path), run_bytes=32 * 32 * 4 * 8)
    assert rows.rdd.getNumPartitions() == 3 * 2
    seen = 0
    for r in rows.collect():
        own = np.frombuffer(r["pixels"], r["dtype"]).reshape(r["bands"], r["height"], r["width"])
        assert (own == cut(all_[r["image_path"]], r["x"], r["y"], r["width"], r["height"])).all()
        seen += own.size
    assert seen == sum(p.size for p in all_.values())
    for options, parts, ok in (({"images": ["p1.tif"]}, 2, lambda r: r["image_path"] == "p1.tif"), ({"images": ["p0.tif", "p2.tif"], "x": (33, None), "y": (None, 32)}, 2, lambda r: r["image_path"] != "p1.tif" and r["x"] >= 32 and r["y"] < 32), ({"x": (33, 65), "y": (64, 65)}, 3, lambda r: r["x"] in (32, 64) and r["y"] == 64), ({"x": (500, None)}, 1, lambda r: False)):
        some = tiff.blocks(spark, str(tmp_path), run_bytes=32 * 32 * 4 * 8, **options)
        assert some.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in rows.collect() if ok(r))


def test_write_points(spark, tmp_path):
    rng = np.random.default_rng(1)
    spots = [(f"i{k % 3}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-20, 320, (4000, 2)))] + [("i0", 5.0, 5.0)] * 9 + [("none", 1.0, 1.0)]
    points = spark.createDataFrame(spots, "image_path string, x double, y double")
    images = spark.createDataFrame([(f"i{k}", 300, 200, 1.0 * k, 9.0, 0.5) for k in range(4)], "image_path string, width int, height int, left double, top double, res double")
    tiff.write_points(points, images, str(tmp_path / "out"), 64)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"i{k}.tif" for k in range(4)]
    for k in range(4):
        expected = np.zeros((200, 300), int)
        for name, x, y in spots:
            if name == f"i{k}" and 0 <= x < 300 and 0 <= y < 200:
                expected[int(y), int(x)] += 1
        raster = tiff.Raster(str(tmp_path / "out" / f"i{k}.tif"))
        assert (raster.window(0, 0, 300, 200)[0] == expected).all() and raster.layout.left == k
    rows = tiff.layouts(spark, str(tmp_path / "out")).select(F.sum("width"), F.min("top"), F.count("epsg")).first()
    assert tuple(rows) == (1200, 9.0, 0)

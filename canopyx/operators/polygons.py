"""Polygons as parts, rings and vertices (column rings): parsing, bounds, area and centroid as column expressions, clipping and
overlap in numpy. The first ring of a part is its border, the others are holes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyx.types import BOX

from . import matching, overlaps, overlay, tiling, validate, vertices


_record = lambda *names: T.StructType([T.StructField(c, T.DoubleType()) for c in names])
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(_record("x", "y"))))


def _area(rings: pa.Array) -> pa.Array:
    at = vertices.Rings(rings)
    return pa.array(at.areas(), mask=~at.known)


def _ring_area(ring: pa.Array) -> pa.Array:
    return pa.array(vertices.ring_areas(ring), mask=ring.is_null().to_numpy(zero_copy_only=False))


def _centre(ring: pa.Array) -> pa.Array:
    x, y = vertices.centroids(ring).T
    known = pc.fill_null(pc.greater(pc.list_value_length(ring), 0), False).to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(v, mask=~known) for v in (x, y)], ["x", "y"])


def parse_wkt(wkt: Column) -> Column:
    """Parts, rings, vertices of POLYGON or MULTIPOLYGON text."""
    return F.arrow_udf(vertices.parse, RINGS)(wkt)


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace sum."""
    return F.arrow_udf(_ring_area, T.DoubleType())(ring)


def clip(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The ring inside a box, one side after another."""
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for k in range(len(ring)):
            a, b = ring[k - 1], ring[k]
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if (da >= 0) != (db >= 0):
                out.append(a + (b - a) * (da / (da - db)))
            if db >= 0:
                out.append(b)
        ring = np.array(out).reshape(-1, 2)
    return ring


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) if len(ring) > 2 else 0.0


def _convex_clip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of the ring a inside the convex ring b, both counter-clockwise."""
    ring = [(float(x), float(y)) for x, y in a]
    corners = [(float(x), float(y)) for x, y in b]
    for k in range(len(corners)):
        (px, py), (qx, qy) = corners[k], corners[(k + 1) % len(corners)]
        out = []
        for i in range(len(ring)):
            (ux, uy), (vx, vy) = ring[i - 1], ring[i]
            su = (qx - px) * (uy - py) - (qy - py) * (ux - px)
            sv = (qx - px) * (vy - py) - (qy - py) * (vx - px)
            if (su >= 0) != (sv >= 0):
                t = su / (su - sv)
                out.append((ux + (vx - ux) * t, uy + (vy - uy) * t))
            if sv >= 0:
                out.append((vx, vy))
        ring = out
    return np.array(ring).reshape(-1, 2)


def _is_convex(r: np.ndarray) -> bool:
    side = np.roll(r, -1, axis=0) - r
    after = np.roll(side, -1, axis=0)
    return bool((side[:, 0] * after[:, 1] - side[:, 1] * after[:, 0] >= 0).all()) and abs(np.arctan2(side[:, 0] * after[:, 1] - side[:, 1] * after[:, 0], (side * after).sum(axis=1)).sum() - 2 * np.pi) < 1e-6


def convex(ring: np.ndarray) -> bool:
    """Whether a ring of either direction is convex."""
    return len(ring) > 2 and _is_convex(ring if signed_area(ring) >= 0 else ring[::-1])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Common area of two simple rings: one cut by the other where that one is convex, else from signed fans of triangles."""
    a, b = (r if signed_area(r) >= 0 else r[::-1] for r in (a, b))
    for p, q in ((a, b), (b, a)):
        if len(q) > 2 and _is_convex(q):
            return abs(signed_area(_convex_clip(p, q)))

    def fan(r):
        r = r if signed_area(r) >= 0 else r[::-1]
        for k in range(1, len(r) - 1):
            t = np.array([r[0], r[k], r[k + 1]])
            s = signed_area(t)
            if s:
                yield (1 if s > 0 else -1), t if s > 0 else t[::-1]

    return sum(s * u * abs(signed_area(_convex_clip(t, q))) for s, t in fan(a) for u, q in fan(b))


def area(rings: Column) -> Column:
    """Area of all parts without their holes."""
    return F.arrow_udf(_area, T.DoubleType())(rings)


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of area of one ring; of its vertices where it has no area."""
    at = F.arrow_udf(_centre, _record("x", "y"))(ring)
    return at["x"], at["y"]


def with_bounds(ann: DataFrame) -> DataFrame:
    """ann with xmin to ymax of its rings."""
    rest = ann.drop(*BOX)
    at = rest.columns.index("rings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box, some = vertices.Rings(batch.column(at)).bounds()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, mask=~some) for v in np.ascontiguousarray(box.T))], [*batch.schema.names, *BOX])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *_record(*BOX).fields]))


def _flat(rings: Column) -> Column:
    """Parts and rings with each ring's coordinates as one list, which crosses to Python as plain numbers."""
    return F.transform(rings, lambda p: F.transform(p, lambda r: F.flatten(F.transform(r, lambda v: F.array(v["x"], v["y"])))))


def _shaped(flat: Column) -> Column:
    """The inverse of _flat()."""
    vertex = lambda r: F.transform(F.sequence(F.lit(1), F.size(r), F.lit(2)), lambda i: F.struct(F.element_at(r, i).alias("x"), F.element_at(r, i + 1).alias("y")))
    return F.transform(flat, lambda p: F.transform(p, vertex))


def _arrays(flat) -> list[list[np.ndarray]]:
    """Parts and rings of a _flat() value as arrays of vertices, the first not repeated at the end."""
    out = []
    for part in flat:
        own = [np.asarray(ring, float).reshape(-1, 2) for ring in part]
        out.append([r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in own])
    return out


def _common_areas(truth: pa.Table, pred: pa.Table) -> Callable:
    """common_area() of pairs of places in two tables with rings, as f(i, j): simple convex rings of one length by the batch."""
    a, b = (vertices.Rings(d["rings"]) for d in (truth, pred))
    sizes = [r.areas() for r in (a, b)]

    def known(r: vertices.Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """Rows' lengths (0 where not of one ring), which are convex, places among their like, and the rings by length."""
        one, at, n = r.plain
        ring = vertices.starts(r.rings)[vertices.starts(r.parts)[:-1][one]]  # the row's only ring
        length, round_, place, by = np.zeros(len(one), np.int64), np.zeros(len(one), bool), np.zeros(len(one), np.int64), {}
        length[one] = n[ring]
        first = np.zeros(len(one), np.int64)
        first[one] = at[ring]
        for m in np.unique(length[length > 2]).tolist():
            own = np.flatnonzero(length == m)
            by[m] = vertices.turned(r.xy[first[own, None] + np.arange(m)])
            round_[own], place[own] = vertices.convex(by[m]), np.arange(len(own))
        return length, round_, place, by

    def rectangles(r: vertices.Rings, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are upright rectangles, and all bounds."""
        one, _, n = r.plain
        box, _ = r.bounds()
        ring = vertices.starts(r.rings)[vertices.starts(r.parts)[:-1]]
        own = np.repeat(r.ring_row, r.vertices)
        beyond = np.bincount(own, ((r.xy != box[own, :2]) & (r.xy != box[own, 2:])).any(axis=1), len(one)) > 0
        four = np.r_[n, 0][np.minimum(ring, len(n))] == 4
        return one & four & ~beyond & (size == (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])), box

    (n, n_round, n_at, n_by), (m, m_round, m_at, m_by) = known(a), known(b)
    (a_box, a_at), (b_box, b_at) = rectangles(a, sizes[0]), rectangles(b, sizes[1])

    def areas(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, kind = np.full(len(i), np.nan), n[i] * (1 + m.max(initial=0)) + m[j]
        box = a_box[i] & b_box[j]
        out[box] = overlaps._common(a_at[i[box]], b_at[j[box]])
        plain = (n[i] > 2) & (m[j] > 2) & ~box
        for k in np.unique(kind[plain]).tolist():
            own = np.flatnonzero(plain & (kind == k))
            p, q = n_by[int(n[i[own[0]]])], m_by[int(m[j[own[0]]])]
            for ring, at, other, to, which in ((p, n_at[i], q, m_at[j], m_round[j[own]]), (q, m_at[j], p, n_at[i], ~m_round[j[own]] & n_round[i[own]])):
                some = own[which]
                if len(some):
                    out[some] = np.abs(vertices.signed(*vertices.cut_convex(ring[at[some]], np.full(len(some), ring.shape[1]), other[to[some]])))
        for k in np.flatnonzero(np.isnan(out)).tolist():
            out[k] = sum((-1 if (x > 0) != (y > 0) else 1) * overlap(r, s) for p in a.row(i[k]) for q in b.row(j[k]) for x, r in enumerate(p) for y, s in enumerate(q))
        return out

    def f(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        inter = np.round(areas(i, j), 9)
        keep = inter > 1e-9
        union = (sizes[0][i] + sizes[1][j] - inter)[keep]
        return keep, inter[keep], inter[keep] / np.where(union > 0, union, 1)

    return f


def overlap_pairs(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """image_path, t_ann_id, p_ann_id, inter, iou of polygons that share area. Candidates are those whose bounds overlap,
    found by grid cells."""
    return overlaps.pairs_by_cell((with_bounds(truth), with_bounds(pred)), ("rings",), _common_areas, "inter double, iou double")


def match_polygons(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """As match_boxes, by the polygons' common area; pairs of polygons are no rows either."""
    chosen = overlaps.assign_boxes(with_bounds(truth), with_bounds(pred), columns=("rings",), measure=_common_areas)
    return matching._partners(chosen.drop("inter"), truth, pred, F.col("iou"))


def per_window(ann: DataFrame, wins: DataFrame, keep_ratio: float = tiling.KEEP_RATIO) -> DataFrame:
    """Polygons cut by each window that their bounds touch and moved to its origin, where more than keep_ratio of the area is
    left; xmin to ymax follow. What a window cuts apart becomes several parts."""
    names = [c for c in ann.columns if c != "rings"]
    near = tiling.annotations_per_window(with_bounds(ann), wins, 0.0).select(*names, "window_index", "window_xmin", "window_ymin", "window_w", "window_h", "rings")
    shown = near.schema.names[:-1]
    schema = T.StructType([*near.schema.fields[:-1], *(T.StructField(c, T.DoubleType()) for c in BOX), T.StructField("rings", near.schema["rings"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = vertices.Rings(batch.column(len(shown)))
            x, y, w, h = (batch.column(shown.index(f"window_{c}")).to_numpy(zero_copy_only=False).astype(float) for c in ("xmin", "ymin", "w", "h"))
            keep, rings = _cut(at, np.stack([x, y, x + w, y + h], axis=1), keep_ratio)
            box, _ = vertices.Rings(rings).bounds()
            some = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([*(c.take(some) for c in batch.columns[:-1]), *map(pa.array, np.ascontiguousarray(box.T)), rings], [*shown, *BOX, "rings"])

    out = near.mapInArrow(run, schema)
    return out.select(*names, "rings", *shown[len(names) :], *BOX)


def _cut(at: vertices.Rings, windows: np.ndarray, keep_ratio: float) -> tuple[np.ndarray, pa.Array]:
    """Which rows keep more than keep_ratio of their area in their window, and what is left of these, moved to its origin.
    Rows of one ring are cut by the batch where it is convex, others one at a time."""
    one, start, n = at.plain
    ring = np.zeros(len(one), np.int64)
    ring[one] = vertices.starts(at.rings)[vertices.starts(at.parts)[:-1][one]]
    length = np.where(one, n[ring] if len(n) else 0, 0)
    # of each row: vertices, sizes of rings and of parts, and its area before and after
    shapes: dict[int, list[list[np.ndarray]]] = {}
    before, after, done = np.zeros(len(one)), np.zeros(len(one)), np.zeros(len(one), bool)
    flat: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for m in np.unique(length[length > 2]).tolist():
        own = np.flatnonzero(length == m)
        xy = at.xy[start[ring[own], None] + np.arange(m)]
        own, xy = (v[vertices.convex(vertices.turned(xy))] for v in (own, xy))
        cut, left = vertices.cut_box(xy, np.full(len(own), m), windows[own])
        before[own], after[own], done[own] = np.abs(vertices.signed(xy)), np.abs(vertices.signed(cut, left)), True
        flat.append((own, cut, left))
    for k in np.flatnonzero(~done).tolist():
        shape, (x, y, x1, y1) = at.row(k), windows[k]
        cut = [[r] for part in shape for r in [clip(part[0], (x, y, x1, y1))] if len(r) > 2] if all(len(p) == 1 and convex(p[0]) for p in shape) else overlay.intersection(shape, [[np.array([(x, y), (x1, y), (x1, y1), (x, y1)])]])
        before[k], after[k] = overlay.area(shape), overlay.area(cut)
        shapes[k] = cut
    with np.errstate(divide="ignore", invalid="ignore"):
        keep = (before > 0) & (after / before > keep_ratio)
    # vertices in the order of rows
    vertex_row, points, sizes, in_part, parts = [], [], {}, {}, np.where(done, 1, 0)
    for own, cut, left in flat:
        own, cut, left = (v[keep[own]] for v in (own, cut, left))
        inner = np.arange(cut.shape[1]) < left[:, None]
        vertex_row.append(np.repeat(own, left))
        points.append(cut[inner])
        sizes.update(zip(own.tolist(), left[:, None].tolist(), strict=True))
    for k, cut in shapes.items():
        if keep[k]:
            rings = [r for part in cut for r in part]
            points.append(np.concatenate(rings))
            vertex_row.append(np.full(len(points[-1]), k))
            sizes[k], in_part[k], parts[k] = [len(r) for r in rings], [len(part) for part in cut], len(cut)
    kept = np.flatnonzero(keep).tolist()
    row = np.concatenate([np.zeros(0, np.int64), *vertex_row])
    order = np.argsort(row, kind="stable")
    xy = np.concatenate([np.zeros((0, 2)), *points])[order] - windows[row[order], :2]
    return keep, vertices.nested(xy, np.array([s for k in kept for s in sizes[k]], np.int64), np.array([s for k in kept for s in in_part.get(k, (1,))], np.int64), parts[keep])


def _crossing(rings: list[np.ndarray]) -> np.ndarray:
    """For each ring whether two of its sides that are no neighbours meet; rings of one length are judged together."""
    turn = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    sizes, out = np.array([len(r) for r in rings], np.int64), np.zeros(len(rings), bool)
    for n in np.unique(sizes[sizes > 3]).tolist():
        own = np.flatnonzero(sizes == n)
        a = np.stack([rings[k] for k in own])
        b, found = np.roll(a, -1, axis=1), np.zeros(len(own), bool)
        for i in range(n - 2):
            j = np.arange(i + 2, n - (i == 0))
            p, q = a[:, i : i + 1], b[:, i : i + 1]
            s, t = turn(p, q, a[:, j]) * turn(p, q, b[:, j]), turn(a[:, j], b[:, j], p) * turn(a[:, j], b[:, j], q)
            found |= ((s < 0) & (t < 0)).any(axis=1)
            if found.all():
                break
        out[own] = found
    return out


def polygon_issues(ann: DataFrame, images: DataFrame, keep: tuple[str, ...] = ("ann_id", "image_path")) -> DataFrame:
    """Rows with a list of what is wrong: no area, crossing sides, under three vertices, or beyond the image."""

    @F.pandas_udf("boolean")
    def crossing(rings: pd.Series) -> pd.Series:
        own = [[r for part in _arrays(v) for r in part] for v in rings]
        flags = _crossing([r for rs in own for r in rs])
        row = np.repeat(np.arange(len(own)), [len(rs) for rs in own])
        return pd.Series(np.bincount(row[flags], minlength=len(own)) > 0)

    rows = with_bounds(ann).join(images, "image_path", "left").withColumn("_crossing", crossing(_flat(F.col("rings"))))
    borders = F.transform("rings", lambda p: p[0])
    rules = {
        "unknown image": F.col("width").isNull(),
        "no area": area(F.col("rings")) == 0,
        "sides cross": F.col("_crossing"),
        "under three vertices": F.size(F.array_distinct(F.flatten(borders))) < 3,
        "xmin < 0": F.col("xmin") < 0,
        "xmax > width": F.col("xmax") > F.col("width"),
        "ymin < 0": F.col("ymin") < 0,
        "ymax > height": F.col("ymax") > F.col("height"),
    }
    return validate._issues(rows, rules, list(keep))

"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its NEAREST nearest reference points (pivots), in order. Vectors with the same set of them are one
signature. Inverted lists, keyed by label and KEY pivots of a signature, hold the signatures; two that meet and share SHARED
pivots or more are candidates, taken from the list of their first common pivots only, so once each. Every vector of the one
is then compared with every vector of the other by exact cosine in blocks of BLOCK, so a crowded signature is many rows and
only links leave a task: each vector's number of them, and a forest that connects what they connect.

The pivots come from a sample of at most SAMPLE distinct vectors, those of least hash: each is the one farthest from those
before it, up to PIVOTS, as long as it is no near-duplicate of one of them (a crowd of near copies would else be cut up by
pivots of its own). Every vector is indexed; a link is missed where two vectors share fewer than SHARED pivots, so recall is
measured (README), and nothing but links is ever found.

Equal vectors of a label are one class, compared once; so are vectors that differ in length alone, up to rounding. Rows with
a null label, and vectors that are null, zero, empty or hold null or non-finite components, link with nothing. Vectors of
different dimension link with nothing. Rows with a null id count as links but never name a component; one alone has a null
component and is kept. Repeated ids are rows of their own. Ids that are no whole numbers raise. Pivots that tie in distance
count in the pivots' order. Vectors of any length count whole. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, integral, materialize, out_schema
from .graph import components

COSINE = 0.93
SAMPLE, PIVOTS, NEAREST, SHARED, KEY = 4096, 256, 8, 3, 3
#: Vectors of a signature that are compared as one matrix.
BLOCK = 256
#: Rows that a task describes or compares at a time.
STEP = 4096


def unit(vector) -> bytes | None:
    """The vector over its length, in double precision; None where it has no direction."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    v /= most  # else squares of very large or small components are lost
    return (v / np.sqrt((v * v).sum())).tobytes()


def _units(column: pa.Array) -> list[bytes | None]:
    """unit() of each row of a list column; rows of one length without nulls at once."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if column.null_count or flat.null_count or not len(sizes) or not sizes[0] or (sizes != sizes[0]).any():
        return [unit(v) for v in column.to_pylist()]
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    most = np.abs(v).max(axis=1)
    good = np.isfinite(most) & (most > 0)
    v = v / np.where(good, most, 1)[:, None]
    with np.errstate(invalid="ignore"):
        v = v / np.where(good, np.sqrt((v * v).sum(axis=1)), 1)[:, None]
    return [v[i].tobytes() if ok else None for i, ok in enumerate(good)]


def unit_vectors(rows: DataFrame, embedding: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` and unit, the direction's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(_units(part.column(len(keep))), pa.binary())], [*keep, "unit"])

    return rows.select(*keep, F.col(embedding)).mapInArrow(run, out_schema(rows, list(keep), "unit binary"))


def _matrix(units: list[bytes], width: int | None = None) -> np.ndarray:
    """Unit vectors as rows, filled with zeros up to the width."""
    sizes = {len(u) for u in units}
    width = width or max(sizes, default=0) // 8
    if sizes == {8 * width}:
        return np.frombuffer(b"".join(units)).reshape(-1, width)
    out = np.zeros((len(units), width))
    for row, u in zip(out, units, strict=True):
        v = np.frombuffer(u)[:width]
        row[: len(v)] = v
    return out


def spread(sample: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Up to so many vectors of the sample, each the farthest from those before it, none as near to one as the cosine."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < most:
        at = int(near.argmin())
        if near[at] >= cosine:
            break
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    return sample[chosen]


def nearest(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each vector's k nearest pivots, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :k]


def describe(classes: DataFrame, pivots: np.ndarray, k: int = NEAREST) -> DataFrame:
    """classes with `order`, the nearest pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                found = nearest(_matrix(part.column(part.schema.get_field_index("unit")).to_pylist(), pivots.shape[1]), pivots, k).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "order"])

    return classes.mapInArrow(run, out_schema(classes, classes.columns, "order array<int>"))


def candidates(signatures: DataFrame, k: int) -> DataFrame:
    """Pairs (a < b) of signatures of a group that share enough pivots. signatures: sid, group, pivots (k of them, sorted)."""
    size, shared = min(KEY, k), min(SHARED, k)
    key = lambda at: F.concat(*(F.col("pivots")[i].cast("string") if j == 0 else F.concat(F.lit(","), F.col("pivots")[i].cast("string")) for j, i in enumerate(at)))
    posted = signatures.select("sid", "group", "pivots", F.explode(F.array(*map(key, itertools.combinations(range(k), size)))).alias("list"))
    a, b = (posted.select("group", "list", F.col("sid").alias(s), F.col("pivots").alias(f"p{s}")) for s in "ab")
    common = F.array_intersect("pa", "pb")
    first = F.array_join(F.slice(common, 1, size), ",") == F.col("list")
    return a.join(by_shuffle(b), ["group", "list"]).where((F.col("a") < F.col("b")) & (F.size(common) >= shared) & first).select("a", "b")


def forest(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest place that each row and each column of a link matrix is connected to; rows come first, then columns."""
    n, m = adjacent.shape
    row, column, far = np.arange(n), n + np.arange(m), n + m
    while True:
        r = np.minimum(row, np.where(adjacent, column[None, :], far).min(axis=1, initial=far))
        c = np.minimum(column, np.where(adjacent, r[:, None], far).min(axis=0, initial=far))
        if (r == row).all() and (c == column).all():
            return row, column
        row, column = r, c


def _compare(cosine: float):
    """Rows of two blocks (nodes, sizes and units each) to node, root (connected to it) and links (weighed by class size)."""

    def one(x, y) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nodes = np.r_[x[0], y[0]]
        hit = _matrix(x[2]) @ _matrix(y[2]).T >= cosine
        if x[0][0] == y[0][0]:  # a block with itself
            np.fill_diagonal(hit, False)
            degree, (root, _) = hit @ np.array(y[1], np.int64), forest(hit | np.eye(len(hit), dtype=bool))
            found = hit.any(axis=1)
            yield np.array(x[0])[found], nodes[root % len(hit)][found], degree[found]
            return
        low = np.r_[forest(hit)]
        degree = np.r_[hit @ np.array(y[1], np.int64), hit.T @ np.array(x[1], np.int64)]
        found = np.r_[hit.any(axis=1), hit.any(axis=0)]
        yield nodes[found], nodes[low[found]], degree[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 3]
            columns = [c.to_pylist() for c in batch.columns]
            single = [k for k in range(batch.num_rows) if len(columns[0][k]) == len(columns[3][k]) == 1 and columns[0][k] != columns[3][k]]
            for at in range(0, len(single), STEP):
                part = single[at : at + STEP]
                x, y = (_matrix([columns[c][k][0] for k in part]) for c in (2, 5))
                hit = np.flatnonzero((x * y).sum(axis=1) >= cosine)
                a, b, na, nb = (np.array([columns[c][part[i]][0] for i in hit], np.int64) for c in (0, 3, 1, 4))
                out += [(a, a, nb), (b, a, na)]
            alone = set(single)
            for k in range(batch.num_rows):
                if k not in alone:
                    out += one(*((columns[c][k], columns[c + 1][k], columns[c + 2][k]) for c in (0, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["node", "root", "links"])

    return run


def links(classes: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS) -> DataFrame:
    """node, root and links: partial sums of each class's links, and edges that connect what links connect.

    classes: node (its number), group (only equal ones are compared), size (rows) and unit.
    """
    sample = classes.orderBy(F.xxhash64("unit"), "node").select("unit").limit(SAMPLE).collect()
    width = max((len(r["unit"]) for r in sample), default=8) // 8
    reference = spread(_matrix([bytes(r["unit"]) for r in sample], width), pivots, cosine) if sample else np.zeros((1, 1))
    k = min(NEAREST, len(reference))
    described = materialize(describe(classes, reference, k), "described").withColumn("pivots", F.sort_array("order"))
    counted = described.groupBy("group", "pivots").agg(F.min("node").alias("sid"), F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n"))
    signatures = materialize(counted, "signatures")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    member = F.struct("node", "size", "unit")
    dealt = described.join(by_shuffle(signatures.select("group", "pivots", "sid", "blocks")), ["group", "pivots"]).groupBy("sid", block).agg(F.collect_list(member).alias("m"))
    blocks = materialize(dealt.select("sid", "block", F.col("m.node").alias("node"), F.col("m.size").alias("size"), F.col("m.unit").alias("unit")), "blocks")
    own = signatures.where("n > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    pairs = candidates(signatures.select("sid", "group", "pivots"), k).unionByName(own)
    x, y = (blocks.select(F.col("sid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("block", "node", "size", "unit"))) for s in "ab")
    both = pairs.join(by_shuffle(x), "a").join(by_shuffle(y), "b").where((F.col("a") != F.col("b")) | (F.col("block_a") <= F.col("block_b")))
    return both.select("node_a", "size_a", "unit_a", "node_b", "size_b", "unit_b").mapInArrow(_compare(cosine), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (the smallest id reachable, its own included) and kept (it is
    its own component's id) for each row."""
    integral(vectors, vec_id)
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v")).withColumn("row", F.monotonically_increasing_id())
    units = unit_vectors(named, "v", ("row", "id", "label"))
    # equal units of a label have one key; the group holds the dimension too
    able = F.col("unit").isNotNull() & F.col("label").isNotNull()
    keyed = units.select("row", "id", F.when(able, F.concat_ws(":", F.length("unit"), "label")).alias("group"), F.when(able, F.sha2("unit", 256)).alias("key"), F.when(able, F.col("unit")).alias("unit"))
    rows = materialize(keyed, "vectors")
    classes = rows.where("key is not null").groupBy("group", "key").agg(F.min("row").alias("node"), F.count("*").alias("size"), F.min("id").alias("low"), F.first("unit").alias("unit"))
    classes = materialize(classes, "classes")
    found = materialize(links(classes.select("node", "group", "size", "unit"), cosine, pivots), "links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), True)
    at = classes.select("group", "key", "node", "size", "low").join(by_shuffle(degree), "node", "left").join(by_shuffle(joined), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = at.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = materialize(at.join(by_shuffle(lows), "root").select("group", "key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "vector-classes")
    own = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.select("id", "group", "key").join(by_shuffle(answers), ["group", "key"]).select("id", "n_links", "component_id").unionByName(own)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

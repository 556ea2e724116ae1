"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits agree, in one of two 32-bit halves, up to one bit. The upper
half is indexed once for each wildcard position with that bit cleared; the lower half is indexed as it is, since a pair
that differs by two bits above must agree below. Equality of keys brings candidates together; each is verified.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are one fingerprint. Rows with a
null id are linked but never name a component; a component of such rows only has a null id. Ids that are no whole numbers
raise. Very long texts count whole. Ties of a bit's majority leave it 0. An empty table gives an empty result. Extra columns
are ignored, whatever their names.

similar() is the same method for a lower similarity: two fingerprints of 64 bits side by side, of which SEGMENTS segments of
WIDTH bits are each indexed with every one bit cleared. Two rows that differ in at most 2 * SEGMENTS - 1 of these bits surely
meet, as one segment differs in one bit at most; farther ones meet by chance. The fingerprints take pairs of words, since a
changed word moves fewer of their bits than of five-word shingles'. Rows that share a key and differ in at most RADIUS bits are
candidates. In each key's group a minimum spanning forest of them is kept and each of its edges is verified by the Jaccard
similarity of the texts' shingles. Where all of a key's edges hold, so does what they connect. In the groups of the others every
candidate whose ends verified links haven't connected is verified too, once for all keys it has, so no candidate that holds is
lost, and a crowd of copies is still one forest. Only texts with equal sets of shingles are one without a check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, integral, map_arrow, materialize, raw_text
from .graph import components

SHINGLE, SEED, BITS = 3, 42, 64
#: Groups of a key up to this size compare all pairs; larger ones look each fingerprint's neighbours up in a sorted array.
SMALL_GROUP = 48


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """Runs of so many lower-cased words joined by spaces, repeats included; the whole sequence where there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    ends, starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), np.zeros(len(words), np.int64)
    starts[1:] = ends[:-1]
    line = b" ".join(words)
    last = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    return [line[a:b] for a, b in zip(starts[:n].tolist(), last, strict=True)]


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64."""
    some, f = shingles(text, size), xxhash.xxh64_intdigest
    h = np.fromiter((f(x, seed) for x in some), np.uint64, len(some))
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        total += np.unpackbits(h[i : i + 4096].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return step

    integral(docs, doc_id)
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw_text(F.col(text)).alias("t")), "doc_id long, fp long", make, 1)


def _masks(upper: int, lower: int) -> list[int]:
    """All masks with so many bits in each half."""
    pick = lambda n: {0: [0], 1: [1 << i for i in range(32)], 2: [1 << i | 1 << j for i in range(32) for j in range(i)]}[n]
    return [a << 32 | b for a in pick(upper) for b in pick(lower)]


def _links(fps: np.ndarray, wild: int) -> list[tuple[int, int]]:
    """Linked pairs (positions) of one key's distinct fingerprints that belong to this key: each pair has one such key.

    wild: the wildcard bit of the upper half, or 32 for the key of the lower half. A pair that agrees above belongs to
    wildcard 0, one that differs in one upper bit to that bit's, and one that differs in two to the lower half's.
    """
    if len(fps) <= SMALL_GROUP:
        i, j = np.triu_indices(len(fps), 1)
        x = fps[i] ^ fps[j]
        up = np.bitwise_count(x >> np.uint64(32))
        own = up == 2 if wild == 32 else (up == 0) & (wild == 0) | (x >> np.uint64(32) == np.uint64(1 << wild))
        ok = own & (np.bitwise_count(x) <= 2)
        return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    if wild == 32:
        masks = _masks(2, 0)
    else:
        bit = 1 << (32 + wild)
        masks = [bit | m for m in _masks(0, 0) + _masks(0, 1)] + (_masks(0, 1) + _masks(0, 2) if wild == 0 else [])
    order, out = np.argsort(fps), []
    ranked = fps[order]
    for m in masks:
        other = ranked ^ np.uint64(m)
        at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
        hit = np.flatnonzero((ranked[at] == other) & (ranked < other))
        out += zip(order[hit].tolist(), order[at[hit]].tolist(), strict=True)
    return out


def _forest(fps: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, one fewer than fingerprints at most."""
    if len(pairs) < 2:
        return pairs
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while i in up:
            if up[i] in up:
                up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(root(i), i) for i in list(up)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by k to verified edges (a, b); holds one batch and the rows of one key."""
    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
        a, b = [], []
        for g in np.flatnonzero(np.diff(cut) > 1):
            own = np.unique(f[cut[g] : cut[g + 1]])
            for i, j in _forest(own, _links(own, int(k[cut[g]] & 63))):
                a.append(own[i])
                b.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        k = np.r_[rest_k, batch.column(0).to_numpy(zero_copy_only=False)]
        f = np.r_[rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(k):
            continue
        full = np.searchsorted(k, k[-1])  # the last key may go on in the next batch
        rest_k, rest_f = k[full:], f[full:]
        yield edges(k[:full], f[:full])
    yield edges(rest_k, rest_f)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) at two differing bits or fewer."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    wild = [F.shiftleft(upper.bitwiseAND(0xFFFFFFFF ^ (1 << j)), 6).bitwiseOR(j) for j in range(32)]
    keys = F.array(*wild, F.shiftleft(lower, 6).bitwiseOR(32))
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k", "fp")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id for each row: the smallest id reachable over links, its own included."""
    fps = materialize(fingerprints(docs, text, doc_id), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-low")
    groups = components(links(distinct.select("fp")))
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(rooted.join(lows, "root").select("fp", "component_id"), "simhash-names")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: Of similar(): words of a fingerprint's shingle, segments (three of each fingerprint) and their bits, and the distance in 128 bits up to which a candidate is worth an exact check.
SKETCH, SEGMENTS, WIDTH, RADIUS = 2, 6, 21, 32
#: What tells texts apart in it: both fingerprints, and a hash of the set of shingles.
NODE = ("x", "y", "z")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest over distances up to RADIUS (Prim's algorithm; memory in proportion to the rows)."""
    n, out = len(fps), []
    near, came, left = np.full(n, RADIUS + 1), np.full(n, -1), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = _distances(fps[at], fps)
        better = left & (d < near)
        near[better], came[better] = d[better], at
        at = int(np.where(left, near, 1 << 20).argmin())
        if came[at] >= 0:
            out.append((int(came[at]), at))
    return out


def _segment(x, y, number: int, shift, low):
    """One of the segments of two fingerprints; shift(v, n) and low(v, n) are a shift to the right and the last n bits."""
    return low(shift((x, y)[number // 3], WIDTH * (number % 3)), WIDTH)


def _low(v, n: int):
    return v & np.uint64((1 << n) - 1)


EDGE = "ax long, ay long, az long, bx long, by long, bz long, k long"


def _by_key(batches: Iterator[pa.RecordBatch], width: int, edges) -> Iterator[pa.RecordBatch]:
    """edges(columns) of batches sorted by their first column, of whole keys; holds one batch and the rows of one key."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * width
    for batch in batches:
        got = [np.r_[r, c.to_numpy(zero_copy_only=False)] for r, c in zip(rest, batch.columns, strict=True)]
        if not len(got[0]):
            continue
        full = np.searchsorted(got[0], got[0][-1])
        rest = [c[full:] for c in got]
        yield edges(*(c[:full] for c in got))
    yield edges(*rest)


def _edge_batch(a: list[np.ndarray], b: list[np.ndarray], k: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros((0, 3), np.uint64)
    ends = np.concatenate([np.concatenate([none, *v]) for v in (a, b)], axis=1).view(np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in ends.T), pa.array(np.concatenate([np.zeros(0, np.int64), *k]))], ["ax", "ay", "az", "bx", "by", "bz", "k"])


def _own(a: np.ndarray, b: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Whether k is the first key that has two rows as a pair: that of the first segment in which they differ in one bit at most,
    with this bit left out, or bit 0 where they agree."""
    x = np.atleast_2d(a ^ b)
    parts = np.stack([_segment(x[:, 0], x[:, 1], n, lambda v, s: v >> np.uint64(s), _low) for n in range(SEGMENTS)])
    meet = np.bitwise_count(parts) <= 1
    first = meet.argmax(axis=0)
    bit = np.bitwise_count(np.maximum(parts[first, np.arange(len(x))], np.uint64(1)) - np.uint64(1))
    return meet.any(axis=0) & (WIDTH * first + bit == (k & 127))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, x, y, z) sorted by k, whose last seven bits name the wildcard, to the edges of their forests."""

    def edges(k: np.ndarray, *node: np.ndarray) -> pa.RecordBatch:
        nodes = np.stack(node, axis=1).view(np.uint64)
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[(_distances(nodes[two, :2], nodes[two + 1, :2]) <= RADIUS) & _own(nodes[two, :2], nodes[two + 1, :2], k[two])]
        a, b, keys = [nodes[two]], [nodes[two + 1]], [k[two]]
        for g in np.flatnonzero(size > 2):
            lo, hi = cut[g], cut[g + 1]
            number, bit = divmod(int(k[lo] & 127), WIDTH)
            own = _segment(nodes[lo:hi, 0], nodes[lo:hi, 1], number, lambda v, n: v >> np.uint64(n), _low) >> np.uint64(bit) & np.uint64(1)
            if bit and own.min() == own.max():
                continue  # they agree in the whole segment: the key without its first bit holds them too
            group = np.unique(nodes[lo:hi], axis=0)
            for i, j in _spanning(group[:, :2]):
                a.append(group[i : i + 1])
                b.append(group[j : j + 1])
                keys.append(k[lo : lo + 1])
        return _edge_batch(a, b, keys)

    yield from _by_key(batches, 4, edges)


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, x, y, low, root) sorted by k to all candidates (low, low) of their groups between different roots. Of the keys
    that two rows share the first has their pair; as their roots differ, not all of its edges held, so it is looked at."""

    def edges(k: np.ndarray, x: np.ndarray, y: np.ndarray, low: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        nodes = np.stack([x, y], axis=1).view(np.uint64)
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
        none = np.zeros(0, np.int64)
        a, b = [none], [none]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if (root[lo:hi] == root[lo]).all():
                continue
            for i in range(lo, hi - 1):
                j = np.flatnonzero((root[i + 1 : hi] != root[i]) & (_distances(nodes[i], nodes[i + 1 : hi]) <= RADIUS)) + i + 1
                j = j[_own(nodes[i], nodes[j], int(k[lo]))]
                a.append(np.repeat(low[i : i + 1], len(j)))
                b.append(low[j])
        one, other = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["a", "b"])

    yield from _by_key(batches, 5, edges)


def sketch(text: bytes, size: int) -> tuple[int, int, int]:
    """Two fingerprints over SKETCH-word shingles, and a hash of the set of shingles of `size` words (0: none), as signed longs."""
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, SKETCH)], np.uint64)
    again = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros((2, BITS), np.int64)
    for i, v in enumerate((h, again ^ again >> np.uint64(29))):
        for at in range(0, len(v), 4096):
            total[i] += np.unpackbits(v[at : at + 4096].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    x, y = np.packbits(2 * total > len(h), axis=1).view(">i8").ravel().tolist()
    own = np.array(sorted({xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)}), np.uint64)
    return x, y, int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def jaccard(a: bytes, b: bytes, size: int) -> float:
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """key and component_id (the smallest key reachable over verified links, its own included) for each row. Keys are whole
    numbers, unique and not null."""
    integral(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("t"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([sketch(t, size) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in got.T)], ["key", *NODE])

        return step

    fps = materialize(map_arrow(rows, "key long, x long, y long, z long", make, 1), "similar")
    distinct = materialize(fps.groupBy(*NODE).agg(F.min("key").alias("low")), "similar-low")
    keys = []
    for number in range(SEGMENTS):
        word = _segment(F.col("x"), F.col("y"), number, F.shiftrightunsigned, lambda v, n: v.bitwiseAND((1 << n) - 1))
        keys += [F.shiftleft(word.bitwiseAND(((1 << WIDTH) - 1) ^ (1 << j)), 7).bitwiseOR(WIDTH * number + j) for j in range(WIDTH)]
    sorted_by_key = lambda d: d.repartition("k").sortWithinPartitions("k")
    spread = lambda d: d.select(F.explode(F.array(*keys)).alias("k"), *NODE)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard(s, t, size) >= similarity for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    # candidates name the smallest row of each set of shingles, whose text stands for all of them
    lows = [distinct.select(*(F.col(c).alias(s + c) for c in NODE), F.col("low").alias(s)) for s in "ab"]

    def named(found: DataFrame) -> DataFrame:
        both = found.join(lows[0], [f"a{c}" for c in NODE]).join(lows[1], [f"b{c}" for c in NODE])
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "k")

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b and ok of the pairs, which are distinct."""
        pairs = materialize(pairs, "similar-edges")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        texts = materialize(rows.join(ends, "key", "left_semi"), "similar-texts")
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("t").alias("s")), "a").join(texts.select(F.col("key").alias("b"), "t"), "b").select("a", "b", "s", "t")
        out = materialize(both.mapInArrow(check, "a long, b long, ok boolean"), "similar-verified")
        discard(pairs, texts)
        return out

    found = materialize(named(sorted_by_key(spread(distinct)).mapInArrow(_forests, EDGE)), "similar-pairs")
    sure = verified(found.select("a", "b").distinct())
    groups = materialize(components(sure.where("ok").select("a", "b")), "similar-groups")
    failed = sure.where("not ok").select("a", "b")
    rooted = distinct.join(groups, F.col("low") == F.col("node"), "left").select("low", "x", "y", F.coalesce("root", "low").alias("root"))
    # a key's candidates are the ends of its edges
    ends = found.select("k", F.explode(F.array("a", "b")).alias("low")).distinct().join(rooted, "low").select("k", "x", "y", "low", "root")
    left = sorted_by_key(ends).mapInArrow(_open_pairs, "a long, b long")
    more = verified(left.join(failed, ["a", "b"], "left_anti"))
    discard(found, groups)
    groups = components(sure.unionByName(more).where("ok").select("a", "b"))
    discard(sure, more)
    answers = distinct.join(groups, F.col("low") == F.col("node"), "left").select(*NODE, F.coalesce("root", "low").alias("component_id"))
    return fps.join(answers, list(NODE)).select("key", "component_id")

"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is the least hash among its 3-word shingles; consecutive windows of a
text that share a minimiser travel as one packed string to the bucket of that minimiser. Equal windows have equal
minimisers and meet in one bucket, where windows are sorted by a 64-bit hash and equal neighbours are compared as text.

Skew: a first pass counts shingles in a fixed number of hash slots. Shingles in overfull slots (a passage that a third
of the texts share) rank last among minimisers, so windows that only touch such a passage are dealt by their other
shingles. Windows wholly inside it repeat exactly: each map step first resolves repeats among its own texts and sends a
window on once, under its smallest id, so a hot window reaches its bucket once per map step at most.

Words are runs of anything but space and \\t\\n\\v\\f\\r, unchanged. Null and empty texts have no words; texts under 13
words lose none. A window goes if it also starts in a row with a smaller id; rows with equal ids never remove each
other's words, and a null id counts as larger than any other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, out_schema, raw_text, steps

WINDOW, SHINGLE = 13, 3
#: Hash slots of the shingle counts, and how often the mean makes a slot overfull.
SLOT_BITS, OVERFULL = 16, 4.0
#: Words that a bucket should hold, bytes of text that a map step resolves, and bytes that are hashed at a time.
BUCKET_WORDS, MAP_BYTES, HASH_BYTES = 1_000_000, 4 << 20, 1 << 17
NO_ID = 2**63 - 1

_P = 0x9E3779B97F4A7C15


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P ** k and its inverse modulo 2 ** 64, for k under n at least."""
    if len(_POWERS.get("up", ())) < n:
        for name, x in (("up", _P), ("down", pow(_P, -1, 2**64))):
            _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, HASH_BYTES), x, np.uint64)])
    return _POWERS["up"], _POWERS["down"]


def word_hashes(line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes, from prefix sums; ends: after the one separator that follows each word."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        o = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, o + HASH_BYTES, "right")))
        part = line[o : ends[j - 1]]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        out[i:j] = (total[ends[i:j] - 1 - o] - total[starts[i:j] - o]) * down[starts[i:j] - o]
        i = j
    out ^= out >> np.uint64(31)
    return out


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, by position; shorter by n - 1."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for i in range(n):
        out *= np.uint64(_P)
        out += h[i : i + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def inside(lengths: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words of the concatenated texts lie in one text."""
    total, ends = int(lengths.sum()), np.cumsum(lengths)
    ok = np.ones(max(total - n + 1, 0), bool)
    for k in range(1, n):
        at = ends - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def minimisers(shingles: np.ndarray, overfull: np.ndarray) -> np.ndarray:
    """Least rank among the shingles of each window; those in overfull slots rank after all others."""
    rank = shingles >> np.uint64(1)
    rank[overfull[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]] |= np.uint64(1 << 63)
    width = WINDOW - SHINGLE + 1
    a = rank
    for step in (1, 2, 4):  # then a holds minima of eight
        a = np.minimum(a[:-step], a[step:]) if len(a) > step else a[:0]
    return np.minimum(a[: len(rank) - width + 1], a[width - 8 :]) if len(rank) >= width else a[:0]


def repeats(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions sorted so that equal hashes are together, the smallest id first."""
    order = np.argsort(h)
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    touched = np.zeros(len(h), bool)
    touched[same] = touched[same + 1] = True
    part = order[touched]
    return part[np.lexsort((part, ids[part], h[part]))]


def covered(h: np.ndarray, ids: np.ndarray, text_of) -> np.ndarray:
    """Windows whose words also start under a smaller id. text_of gives a window's exact words."""
    part, out = repeats(h, ids), np.zeros(len(h), bool)
    at = 0
    cut = np.flatnonzero(np.r_[True, h[part[1:]] != h[part[:-1]], True]) if len(part) else np.zeros(1, np.int64)
    for end in cut[1:].tolist():
        group = part[at:end].tolist()
        first: dict[bytes, int] = {}
        for g in group:
            low = first.setdefault(text_of(g), ids[g])
            out[g] = low < ids[g]
        at = end
    return out


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of True in mask that no break divides (breaks: a run may not go on from here)."""
    before = np.r_[False, mask[:-1]] & ~breaks
    starts = np.flatnonzero(mask & ~before)
    after = np.r_[mask[1:] & ~breaks[1:], False]
    return starts, np.flatnonzero(mask & ~after) - starts + 1


class Step:
    """The words of some texts, concatenated with one space after each."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        before = np.r_[True, space[:-1]]
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.lengths = np.diff(np.searchsorted(np.flatnonzero(~space & before), first))
        line = raw[~(space & before)].copy()
        line[(line >= 9) & (line <= 13)] = 32
        self.ends = np.flatnonzero(line == 32) + 1
        self.starts = np.r_[0, self.ends[:-1]][: len(self.ends)]
        self.hashes, self.line = word_hashes(line, self.starts, self.ends), line.tobytes()

    def text(self, first: int, n: int = WINDOW) -> bytes:
        return self.line[self.starts[first] : self.ends[first + n - 1] - 1]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def shingle_slots(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Overfull slots and the number of words over all texts (column t); what reaches the driver is one row for each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, words = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in steps(batches, 0, MAP_BYTES):
            s = Step(batch.column(0).to_pylist())
            words += len(s.hashes)
            h = run_hash(s.hashes, SHINGLE)[inside(s.lengths, SHINGLE)]
            slots += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[slots[at], words])], ["slot", "n"])

    got = docs.select("t").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    slots, at = np.zeros(1 << SLOT_BITS, np.int64), got["slot"].to_numpy(int)
    slots[at[at >= 0]] = got["n"].to_numpy(int)[at >= 0]
    return slots > max(64, OVERFULL * slots.mean()), int(got["n"].to_numpy(int)[at < 0].sum())


def pack(docs: DataFrame, overfull: np.ndarray, buckets: int) -> DataFrame:
    """Rows (id, key, t) to rows: bucket with a compressed blob of super-k-mers, or a text's range that its own map step resolved.

    A blob holds its texts' ids and keys, and for each super-k-mer its text, the place of its first word, and its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(overfull)
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, zip_ = shared.value, zstandard.ZstdCompressor(level=6)
        for batch in steps(batches, 2, MAP_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            s = Step(batch.column(2).to_pylist())
            if len(s.hashes) < WINDOW:
                continue
            ok, owner = inside(s.lengths, WINDOW), s.owners()
            owner_w = owner[: len(ok)]
            least = minimisers(run_hash(s.hashes, SHINGLE), full)
            h = run_hash(s.hashes, WINDOW)
            at = np.flatnonzero(ok)
            done = np.zeros(len(ok), bool)
            done[at] = covered(h[at], ids[owner_w[at]], lambda g, at=at, s=s: s.text(int(at[g])))
            breaks = np.r_[True, owner_w[1:] != owner_w[:-1]]
            base = np.cumsum(s.lengths) - s.lengths
            a, n = runs(ok & done, breaks)
            who = owner_w[a]
            out = [((x[0] ^ x[1]) % buckets, *x, None) for x in zip(ids[who].tolist(), keys[who].tolist(), (a - base[who]).tolist(), n.tolist(), strict=True)]
            a, n = runs(ok & ~done, breaks | np.r_[True, least[1:] != least[:-1]])
            bucket = (least[a] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            a, n, bucket = a[order], n[order], bucket[order]
            lo, hi, who = s.starts[a], s.ends[a + n + WINDOW - 2] - 1, owner_w[a]
            head = np.stack([who, a - base[who]]).astype(np.int32)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(a) else np.zeros(1, np.int64)
            lo, hi = lo.tolist(), hi.tolist()
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                body = b"\n".join([s.line[lo[z] : hi[z]] for z in range(x, y)])
                own, place = np.unique(head[0, x:y], return_inverse=True)
                table = np.stack([ids[own], keys[own]])
                places = np.stack([np.diff(place, prepend=0), head[1, x:y]]).astype(np.int32)
                blob = np.array([len(own), y - x]).tobytes() + table.tobytes() + places.tobytes() + body
                out.append((int(bucket[x]), None, None, None, None, zip_.compress(blob)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

    return docs.select("id", "key", "t").mapInArrow(run, "bucket long, id long, key long, first long, n long, blob binary")


def resolve(blobs: DataFrame, buckets: int) -> DataFrame:
    """Rows (id, key, first, n): windows first to first + n - 1 of that text are covered. A task holds one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        # of super-k-mers: id, key and place (heads); of their windows: hash, range in the line, super-k-mer and place in it
        heads, hashes, lows, highs, owners, places, line, before = [], [], [], [], [], [], bytearray(), 0
        for batch in batches:
            near = batch.filter(pc.is_null(batch.column(5)))
            yield pa.RecordBatch.from_arrays(near.columns[1:5], ["id", "key", "first", "n"])
            for z in batch.column(5).drop_null():
                blob = unzip.decompress(z.as_buffer())
                own, n = np.frombuffer(blob, np.int64, 2).tolist()
                table = np.frombuffer(blob, np.int64, 2 * own, 16).reshape(2, own)
                place = np.frombuffer(blob, np.int32, 2 * n, 16 + 16 * own).reshape(2, n).astype(np.int64)
                heads.append(np.vstack([table[:, np.cumsum(place[0])], place[1:]]))
                body = blob[16 + 16 * own + 8 * n :] + b" "
                part = np.frombuffer(body, np.uint8)
                end = np.flatnonzero((part == 32) | (part == 10)) + 1
                start = np.r_[0, end[:-1]]
                # a super-k-mer ends at each line feed; words hold none
                length = np.diff(np.r_[0, np.flatnonzero(part[end - 1] == 10) + 1, len(end)])
                valid = np.flatnonzero(inside(length, WINDOW))
                owner = np.repeat(np.arange(len(length)), length)[valid]
                hashes.append(run_hash(word_hashes(part, start, end), WINDOW)[valid])
                lows.append(start[valid] + len(line))
                highs.append(end[valid + WINDOW - 1] - 1 + len(line))
                owners.append(owner + before)
                places.append((valid - (np.cumsum(length) - length)[owner]).astype(np.int32))
                before += n
                line += body
        if not heads:
            return
        head, w, owner = np.concatenate(heads, axis=1), np.concatenate(hashes), np.concatenate(owners)
        low, high, place = np.concatenate(lows), np.concatenate(highs), np.concatenate(places)
        del heads, hashes, lows, highs, owners, places
        done = covered(w, head[0][owner], lambda g: bytes(line[low[g] : high[g]]))
        a, n = runs(done, np.r_[True, owner[1:] != owner[:-1]])
        who = owner[a]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head[0][who], head[1][who], head[2][who] + place[a], n)], ["id", "key", "first", "n"])

    return blobs.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, "id long, key long, first long, n long")


def kept_words(text: bytes, firsts: list[int], counts: list[int]) -> tuple[list[bytes], int]:
    """A text's words without the covered ones, and how many there were."""
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    if firsts:
        np.add.at(gone, np.array(firsts), 1)
        np.add.at(gone, np.array(firsts) + np.array(counts) + WINDOW - 1, -1)
        gone = np.cumsum(gone)
        return [w for w, g in zip(words, gone.tolist(), strict=False) if not g], len(words)
    return words, len(words)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by spaces, binary) and the columns `keep` for each row."""
    raw = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), raw_text(F.col(text)).alias("t"))
    keyed = raw.withColumn("key", F.xxhash64("t"))
    overfull, n_words = shingle_slots(keyed)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-n_words // BUCKET_WORDS))
    found = materialize(resolve(pack(keyed, overfull, buckets), buckets), "covered")
    ranges = found.groupBy("id", "key").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))
    whole = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), raw_text(F.col(text)).alias("_t"))
    whole = whole.withColumn("_key", F.xxhash64("_t"))
    both = whole.join(ranges, (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("key")), "left").select("doc_id", *keep, "_t", "first", "n")
    names = ["doc_id", *keep]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, before, gone = [], [], []
            for t, f, n in zip(*(batch.column(len(names) + i).to_pylist() for i in range(3)), strict=True):
                words, size = kept_words(t, f or [], n or [])
                kept.append(b" ".join(words))
                before.append(size)
                gone.append(size - len(words))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_words", "n_removed", "kept"])

        return step

    schema = out_schema(both, names, "n_words long, n_removed long, kept binary")
    return map_arrow(both, schema, make, len(names))

"""Best-fit packing of token sequences, bulk-synchronous.

Documents stay distributed: they are range-sorted by length and ranked within their length. The packing itself works on
runs, documents of equal length and sequences of equal gap, of which there are never more than the capacity allows,
however many documents there are. In a round, every run of documents in the current band of lengths takes the successor
of its length among the sorted gaps; where several want one gap, longer ones come first and ranks decide who gets which
sequence; then the gaps are updated, and the round repeats until the band is placed. A document finds its sequence by its
length and rank. So what passes the driver is bounded by the capacity, not by the documents.

Null and empty texts are one piece with the end id alone. Rows with equal ids are packed apart. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO_PIECES, encode_piece
from .common import map_arrow, materialize, out_schema, raw_text

CAPACITY = 2048
#: Longer matches of the split pattern are encoded by segment tree: tiktoken fails on runs of some 100,000 spaces.
LONG_PIECE = 4096
#: Lengths that are matched in the same rounds.
BAND = 32


def added_tokens(file: str) -> dict[str, int]:
    """Added tokens of a tokenizers JSON file with their ids. They are found in the raw text, before the split pattern applies."""
    with open(file, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r} takes its surroundings into account")
    return {t["content"]: t["id"] for t in added}


class Encoder(dict):
    """Matches of the split pattern to their ids as little-endian bytes, remembered. added: tokens that are one id wherever they stand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None):
        import regex
        import tiktoken

        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece) if len(piece) <= LONG_PIECE else encode_piece(piece.encode(), self.ranks)
        found = self[piece] = np.array(ids, "<u4").tobytes()
        return found

    def ids(self, text: str) -> bytes:
        if len(self) > MEMO_PIECES:
            self.clear()
        out = []
        for k, part in enumerate(self.parts(text)):  # every other part is an added token
            if k % 2:
                out.append(self.added[part])
            else:
                out += map(self.__getitem__, self.split(part))
        return b"".join(out)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter, the others are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """keep, piece, start, length, ids_crc32: each document's ids, an end id 0 included, in pieces of the capacity at most."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, added))
    names = list(keep)

    def make():
        encoder = Encoder(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            source, rows = [], []
            for i, v in enumerate(batch.column(len(names)).to_pylist()):
                ids = encoder.ids(v.decode("utf-8", "replace")) + bytes(4)
                for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    source.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*(pc.take(c, pa.array(source)) for c in batch.columns[: len(names)]), *new], [*names, "piece", "start", "length", "ids_crc32"])

        return step

    schema = out_schema(docs, names, "piece int, start long, length long, ids_crc32 long")
    return map_arrow(docs.select(*names, raw_text(F.col(text)).alias("_t")), schema, make, len(names))


class Runs:
    """Sequences by gap, as runs of consecutive sequence numbers."""

    def __init__(self):
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self.opened = 0

    def add(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.by_gap.setdefault(gap, []).append((first, n))

    def open(self, n: int, capacity: int) -> None:
        self.add(capacity, self.opened, n)
        self.opened += n

    def take(self, gap: int, n: int) -> list[tuple[int, int]]:
        """Up to n sequences with this gap."""
        out, runs = [], self.by_gap.get(gap, [])
        while n and runs:
            first, have = runs.pop()
            use = min(n, have)
            out.append((first, use))
            if have > use:
                runs.append((first + use, have - use))
            n -= use
        if not runs:
            self.by_gap.pop(gap, None)
        return out


def match(counts: np.ndarray, capacity: int = CAPACITY, band: int = BAND) -> tuple[dict[int, np.ndarray], int]:
    """counts: documents by length. For each length, rows (rank of the first document, first sequence, offset), and the number of sequences."""
    left, rank, runs = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), Runs()
    found: dict[int, list[tuple[int, int, int]]] = {}
    for top in range(capacity, 0, -band):
        wanted = [x for x in range(top, max(top - band, 0), -1) if left[x]]
        while wanted:
            gaps = np.array(sorted(runs.by_gap), np.int64)
            place = np.searchsorted(gaps, wanted)
            if place[0] == len(gaps):  # the longest fits nowhere: open what its run needs
                runs.open(-(-int(left[wanted[0]]) // (capacity // wanted[0])), capacity)
                continue
            now = []  # bulk-synchronous: all proposals see the gaps of the round's start
            for x, p in zip(wanted, place.tolist(), strict=True):
                if p < len(gaps):
                    for first, n in runs.take(int(gaps[p]), int(left[x])):
                        found.setdefault(x, []).append((int(rank[x]), first, capacity - int(gaps[p])))
                        rank[x] += n
                        left[x] -= n
                        now.append((int(gaps[p]) - x, first, n))
            for change in now:
                runs.add(*change)
            wanted = [x for x in wanted if left[x]]
    return {x: np.array(rows, np.int64) for x, rows in found.items()}, runs.opened


def pack(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """parts and sequence_id, offset. parts has a long column length; `order` breaks ties between equal lengths."""
    names = parts.columns
    where = names.index("length")
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = parts.repartitionByRange(n, "length", *order).sortWithinPartitions("length", *order)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column(where).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]) if len(size) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[starts, len(size)])
            own = np.arange(len(size)) - np.repeat(starts, counts) + seen[size]
            seen[size[starts]] += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), task, np.int64)), pa.array(own)], [*names, "_task", "_rank"])

    ranked = materialize(ranged.mapInArrow(rank, out_schema(parts, names, "_task long, _rank long")), "ranked")
    tally = ranked.groupBy("_task", "length").count().orderBy("_task").toPandas()  # ranges: tasks + lengths rows at most
    counts, offsets = np.zeros(capacity + 1, np.int64), {}
    for t, x, c in tally.itertuples(index=False):
        offsets[int(t), int(x)] = int(counts[x])
        counts[x] += c
    shared = parts.sparkSession.sparkContext.broadcast((offsets, match(counts, capacity)[0]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found = shared.value
        for batch in batches:
            size, task, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (where, len(names), len(names) + 1))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x, t in set(zip(size.tolist(), task.tolist(), strict=True)):
                at = np.flatnonzero((size == x) & (task == t))
                r, rows = own[at] + before[t, x], found[x]
                k = np.searchsorted(rows[:, 0], r, "right") - 1
                seq[at], off[at] = rows[k, 1] + r - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, out_schema(parts, names, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", doc_id: str = "doc_id", added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. added: the tokenizer's added tokens with their ids."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return pack(materialize(pieces(named, ranks, pattern, added=added), "pieces"))



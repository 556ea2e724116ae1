"""Byte-level BPE encoding and decoding with given ranks.

Each match of a split pattern is encoded by itself. A segment tree over its byte positions holds at each live position
the rank of the pair that starts there; the root is the least rank, leftmost. A merge changes the leaves of the merged
position, its right neighbour and its left neighbour: logarithmic updates, so a match of any length takes n log n steps.

Null and empty texts have no tokens. Repeated texts have equal rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, out_schema, raw_text

#: Distinct matches that a task remembers.
MEMO_PIECES = 500_000
_NONE = 1 << 62
_PLACE = (1 << 40) - 1


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """Ranks from a tiktoken file's lines: base64 of the token, a space, its rank."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, size = len(piece), 1 << max(len(piece) - 1, 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 40 | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, stop: int) -> None:
        """The leaf of position i: its pair's rank if the pair ends at stop, none for stop 0."""
        r = ranks.get(piece[i:stop]) if stop else None
        v, i = _NONE if r is None else r << 40 | i, size + i
        tree[i] = v
        while i > 1:
            i >>= 1
            v = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == v:
                return
            tree[i] = v

    while tree[1] != _NONE:
        i = tree[1] & _PLACE
        gone = end[i]
        end[i] = stop = end[gone]
        put(gone, 0)
        put(i, end[stop] if stop < n else 0)
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            put(before[i], stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Trees:
    """The same segment trees for many short matches at once, one row each."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]] << 20 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes2 = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, _NONE >> 8 where they don't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE >> 8)

    def encode(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Matches of 2 to `size` bytes, a power of two up to 128. A leaf is the pair's rank, then its position."""
        m, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
        place = np.arange(size)
        alive = place < lengths[:, None]
        ids = self.byte[data]
        follow, before = np.tile(np.arange(1, size + 1), (m, 1)), np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), _NONE, np.int64)
        tree[:, size : 2 * size - 1] = np.where(alive[:, 1:], self.bytes2[data[:, :-1], data[:, 1:]] << 8 | place[:-1], _NONE)
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        row = np.arange(m)
        while True:
            top = tree[row, 1]
            go = top < _NONE >> 8 << 8
            row, top = row[go], top[go]
            if not len(row):
                break
            i, merged = top & 255, top >> 8
            gone = follow[row, i]
            after = follow[row, gone]
            ids[row, i], follow[row, i], before[row, after], alive[row, gone] = merged, after, i, False
            left = before[row, i]
            right_ok, left_ok = after < lengths[row], left >= 0
            left = np.maximum(left, 0)
            tree[row, size + gone] = _NONE
            tree[row, size + i] = np.where(right_ok, self.rank(merged, ids[row, np.minimum(after, size - 1)]) << 8 | i, _NONE)
            new = np.where(left_ok, self.rank(ids[row, left], merged) << 8 | left, tree[row, size + left])
            tree[row, size + left] = new
            for at in (gone, i, left):
                q = (size + at) >> 1
                while q[0]:
                    tree[row, q] = np.minimum(tree[row, 2 * q], tree[row, 2 * q + 1])
                    q >>= 1
        flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec(dict):
    """Remembers each match's ids, their decimal text and the bytes that they decode to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens, self.trees = {r: t for t, r in ranks.items()}, Trees(ranks)

    def learn(self, pieces: set[str]) -> None:
        """Encodes the matches that are new: short ones in batches of one tree size, others one by one."""
        if len(self) > MEMO_PIECES:
            self.clear()
        sizes: dict[int, list[str]] = {}
        for p in pieces.difference(self):
            b = p.encode()
            if b in self.ranks or len(b) > 64:
                self.put(p, encode_piece(b, self.ranks))
            else:
                sizes.setdefault(max(8, 1 << (len(b) - 1).bit_length()), []).append(p)
        for size, part in sizes.items():
            for i in range(0, len(part), 4096):
                some = part[i : i + 4096]
                for p, ids in zip(some, self.trees.encode([p.encode() for p in some], size), strict=True):
                    self.put(p, ids)

    def put(self, piece: str, ids: list[int]) -> None:
        self[piece] = len(ids), ",".join(map(str, ids)).encode(), self.decode(ids), ids

    def pieces(self, texts: list[str]):
        """The remembered matches of each text."""
        split = [self.split(t) for t in texts]
        self.learn({p for found in split for p in found})
        return [list(map(self.__getitem__, found)) for found in split]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces([text])[0] for i in p[3]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _over(df: DataFrame, column, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...], extra: list[tuple[str, pa.DataType]], schema: str, row) -> DataFrame:
    """keep and the columns that row(a text's matches) gives; the ranks are broadcast, their size is the vocabulary's."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    names = list(keep)

    def make():
        codec = Codec(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [v.decode("utf-8", "replace") for v in batch.column(len(names)).to_pylist()]
            rows = [row(found) for found in codec.pieces(texts)]
            new = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), extra, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, *(n for n, _ in extra)])

        return step

    return map_arrow(df.select(*names, column.alias("_v")), out_schema(df, names, schema), make, len(names))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and ids, an array of int."""
    row = lambda found: ([i for p in found for i in p[3]],)
    return _over(docs, raw_text(F.col(text)), ranks, pattern, keep, [("ids", pa.list_(pa.int32()))], "ids array<int>", row)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, and SHA-256 of the decimal ids joined by commas and of the bytes decoded from the ids."""

    def row(found: list[tuple]) -> tuple[int, str, str]:
        ids, back = b",".join([p[1] for p in found]), b"".join([p[2] for p in found])
        return sum([p[0] for p in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    extra = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _over(docs, raw_text(F.col(text)), ranks, pattern, keep, extra, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text, binary, from an array of ids; null ids give empty bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    names = list(keep)

    def run(batches):
        codec = Codec(shared.value, ".")
        for batch in batches:
            back = [codec.decode(v or []) for v in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(back, pa.binary())], [*names, "text"])

    return tokens.select(*names, F.col(ids)).mapInArrow(run, out_schema(tokens, names, "text binary"))

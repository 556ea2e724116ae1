"""Alignment of two tokenizers over the same bytes.

The tokens' end offsets of both sides cut a text into elementary intervals: their union, each with one owner a side, found by
binary search. An interval is one overlap of two tokens; where both owners end with it, a group closes, and the tokens that
end there are linked, each with each.

Links are counted over the corpus by pair of ids. Two linked tokens end together, so one's bytes are a suffix of the other's:
the vocabularies bound how many pairs there can be (pair_bound()), whatever the corpus. Below MAX_PAIRS the counts travel to
the tasks as one sorted array; above, texts and counts meet in a join.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens. Repeated rows count each.
Pairs that tie for the best count are all best. Very long texts count whole. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, out_schema, raw_text
from .packing import Encoder

#: Distinct pairs of ids, at 17 bytes each, that a task may hold.
MAX_PAIRS = 8_000_000


class ByteLevel:
    """Ranks over bytes; sees the text with a space before it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def table(self) -> list[bytes]:
        out = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def encoder(self) -> Callable[[str], np.ndarray]:
        encoder = Encoder(self.ranks, self.pattern)
        return lambda text: np.frombuffer(encoder.ids(" " + text), "<u4").astype(np.int64)


class Pieces:
    """A sentencepiece model, given as its file's bytes; puts a space before the text itself."""

    def __init__(self, model: bytes):
        self.model = model

    def _processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def table(self) -> list[bytes]:
        p = self._processor()
        name = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        return [bytes([int(x[1:-1], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(name)]

    def encoder(self) -> Callable[[str], np.ndarray]:
        p = self._processor()
        return lambda text: np.array(p.encode(text, num_threads=1), np.int64)


Tokens = ByteLevel | Pieces


def intervals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, and which tokens own them, from both sides' token ends."""
    ends = np.union1d(a, b)
    return ends, np.searchsorted(a, ends), np.searchsorted(b, ends)


def shared_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where tokens of both sides end."""
    ends, i, j = intervals(a, b)
    return ends[(a[np.minimum(i, len(a) - 1)] == ends) & (b[np.minimum(j, len(b) - 1)] == ends)] if len(a) and len(b) else ends[:0]


def products(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of tokens that end at one of the ends: several a side only where tokens have no bytes."""
    a0, b0 = np.searchsorted(a, ends), np.searchsorted(b, ends)
    na, nb = np.searchsorted(a, ends, "right") - a0, np.searchsorted(b, ends, "right") - b0
    each = na * nb
    k = np.repeat(np.arange(len(ends)), each)
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return a0[k] + within // nb[k], b0[k] + within % nb[k]


class Aligner:
    """Both sides of a text: ids, and after how many tokens each group closes."""

    def __init__(self, a: Tokens, b: Tokens):
        self.tables = a.table(), b.table()
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in self.tables]
        self.encoders = a.encoder(), b.encoder()

    def __call__(self, text: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and ends of both sides, and the shared ends."""
        none = np.zeros(0, np.int64)
        if text:
            ids = [encode(text) for encode in self.encoders]
            whole = b" " + text.encode()
            if all(b"".join(map(table.__getitem__, own.tolist())) == whole for table, own in zip(self.tables, ids, strict=True)):
                ends = [np.cumsum(size[own]) for size, own in zip(self.sizes, ids, strict=True)]
                return ids, ends, shared_ends(*ends)
        return [none, none], [none, none], none


def _closes(ends: list[np.ndarray], shared: np.ndarray) -> list[np.ndarray]:
    return [np.searchsorted(e, shared, "right") for e in ends]


class Spelling:
    """Groups as text, `a1,a2|b1;a3|b2,b3`, from a table of each id with each sign that may follow it."""

    def __init__(self, sizes: tuple[int, int]):
        self.starts = np.cumsum([0, sizes[0], sizes[0], sizes[1]])
        self.table = np.array([f"{i}{sign}" for size, signs in zip(sizes, (",|", ",;"), strict=True) for sign in signs for i in range(size)], object)

    def __call__(self, ids: list[np.ndarray], closes: list[np.ndarray]) -> str:
        """closes: how many tokens of each side the groups so far have."""
        if not len(closes[0]):
            return ""
        out = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        for side, own in enumerate(ids):
            group = np.zeros(len(own), np.int64)
            group[closes[side][:-1]] = 1
            group = np.cumsum(group)  # a token stands behind the other side's tokens up to its group, without or with it
            before = np.r_[0, closes[1 - side]][group + side]
            last = np.zeros(len(own), np.int64)
            last[closes[side] - 1] = 1
            out[np.arange(len(own)) + before] = own + np.where(last, self.starts[2 * side + 1], self.starts[2 * side])
        return "".join(self.table[out].tolist())[:-1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.array([len(a) for a in arrays], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat.astype(np.int32)))


def align(docs: DataFrame, a: Tokens, b: Tokens, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, a_ids and b_ids, and a_closes and b_closes: how many tokens of each side the groups so far have."""

    def make():
        both = Aligner(a, b)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for raw in batch.column(len(keep)).to_pylist():
                ids, ends, shared = both(raw.decode())
                for column, values in zip(out, [*ids, *_closes(ends, shared)], strict=True):
                    column.append(values)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(_lists, out)], [*keep, *_ALIGNED])

        return step

    return map_arrow(docs.select(*keep, raw_text(F.col(text)).alias("_t")), out_schema(docs, list(keep), ", ".join(f"{c} array<int>" for c in _ALIGNED)), make, len(keep))


_ALIGNED = ("a_ids", "b_ids", "a_closes", "b_closes")


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together at most: those where one's bytes are a suffix of the other's."""
    left, right = Counter(a), Counter(b)
    longer = lambda some, others: sum(n * others[t[i:]] for t, n in some.items() for i in range(len(t) + 1))
    return longer(left, right) + longer(right, left)


def _summaries(docs: DataFrame, a: Tokens, b: Tokens, text: str, keep: tuple[str, ...]) -> DataFrame:
    """A row's figures, and its distinct linked pairs of ids with their number of links."""

    def make():
        both = Aligner(a, b)
        spell = Spelling(tuple(map(len, both.tables)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            figures, digests, pairs = [], [], ([], [], [])
            for raw in batch.column(len(keep)).to_pylist():
                ids, ends, shared = both(raw.decode())
                i, j = products(*ends, shared)
                linked, times = np.unique(ids[0][i] << 32 | ids[1][j], return_counts=True)
                figures.append((len(ids[0]), len(ids[1]), len(shared), len(i)))
                digests.append(hashlib.sha256(spell(ids, _closes(ends, shared)).encode()).hexdigest() if len(ids[0]) else "")
                for column, values in zip(pairs, (linked >> 32, linked & 0xFFFFFFFF, times), strict=True):
                    column.append(values)
            counts = np.array(figures, np.int64).reshape(-1, 4)
            columns = [*batch.columns[: len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in counts.T), pa.array(digests, pa.string()), *map(_lists, pairs)]
            return pa.RecordBatch.from_arrays(columns, out.names)

        return step

    out = out_schema(docs, list(keep), "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _a array<int>, _b array<int>, _n array<int>")
    return map_arrow(docs.select(*keep, raw_text(F.col(text)).alias("_t")), out, make, len(keep))


def _exploded(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.explode(F.arrays_zip("_a", "_b", "_n")).alias("p")).select(*more, F.col("p._a").alias("a"), F.col("p._b").alias("b"), F.col("p._n").cast("long").alias("n"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, links (of the pair in the corpus), best: no other pair with this b has more."""
    counts = _exploded(rows).groupBy("a", "b").agg(F.sum("n").alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _by_lookup(rows: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    got = counts.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("k"), "links", "best").toArrow()
    key, links, best = (got.column(c).to_numpy() for c in ("k", "links", "best"))
    order = np.argsort(key)
    held = rows.sparkSession.sparkContext.broadcast((key[order], links[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, links, best = held.value
        for batch in batches:
            lists = batch.columns[len(names) :]
            a, b, n = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
            at = np.searchsorted(key, a << 32 | b)
            cuts = np.r_[0, np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
            sums = [np.diff(np.r_[0, np.cumsum(v)][cuts]) for v in (n * best[at], n * links[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    return rows.select(*names, "_a", "_b", "_n").mapInArrow(run, out_schema(rows, names, "n_best long, count_sum long"))


def _by_join(rows: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    rows = materialize(rows.withColumn("_key", F.monotonically_increasing_id()), "aligned-keyed")
    sums = _exploded(rows, "_key").join(counts, ["a", "b"]).groupBy("_key").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    return rows.join(sums, "_key", "left").select(*names, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))


def score(docs: DataFrame, a: Tokens, b: Tokens, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = MAX_PAIRS) -> DataFrame:
    """The columns `keep`, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each row.

    Texts are encoded once; figures and pairs are a table in the shared folder, from which pairs are counted and then
    looked up.
    """
    rows = materialize(_summaries(docs, a, b, text, keep), "aligned")
    names = [c for c in rows.columns if c not in ("_a", "_b", "_n")]
    look = _by_lookup if pair_bound(a.table(), b.table()) <= most else _by_join
    return look(rows, pair_counts(rows), names)

"""Language-model scoring by online logistic context mixing.

A text is its tokens: words (runs of anything but space and \\t\\n\\v\\f\\r, A-Z lower-cased), then an end. Each token is
spelled as bytes and each byte as eight bits. Several predictors, each with a hashed context of the text's class and the
word so far (the last one to four bytes, and the whole prefix), keep counts of zeros and ones; their stretched
predictions are mixed with weights that two gates select, by how often the longer contexts were seen and by the bit's
place. The mix is refined by an adaptive map from the partial byte and the mixed probability to what came out. Weights
and map are learned online, block by block, each token's own occurrence taken out of the counts. These contexts stay within
a word, so a word is spelled at one price in each class, computed once however often it occurs.

Two more bits stand above the spelling. One says whether a word comes from the class's dictionary, the words counted in the
corpus, or is spelled; both ways are summed. The other crosses words: a phrase is the context of the next one (phrases.py),
and the words of a phrase that its context foretold cost nothing beyond the bit. Both tables grow with the corpus.

A text's class is the nearest of CLASSES centroids of byte profiles, fitted to all texts to learn from; the score pays for
naming it, so it stays a probability of the text.

How it is spread: distinct words are counted once over all texts. Tasks count contexts over the words into tables of a
fixed size, summed in chunks; tasks learn over their words from the same start, and their weights and maps are averaged.
The TOP most frequent words also travel to the tasks with their scores (a fixed number); the texts' other words, none of
which can be hot, join the word table by an equi-join.

Null and empty texts are an end alone. Equal rows get equal scores. With no training rows every token is unknown and
the model knows no counts. Rows with a null id are held out of neither part: crc32 of null is null, they are not learned
from and their held_out is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import phrases
from .common import map_arrow, materialize, out_schema, raw_text
from .substring import Step, powers

END = b"\n"
TOP, MEMO_WORDS = 1 << 17, 500_000
#: Bytes of context, None for the whole prefix, and the address bits of each context's table.
ORDERS, BITS = (1, 2, 3, 4, None), (17, 18, 19, 20, 20)
#: Classes of texts, passes over all texts that settle their centroids, and the fractions that profiles are added in.
CLASSES, ROUNDS, UNIT = 8, 2, 1 << 20
#: Where phrases join back, rows of a text that over one row in HOT holds are dealt to so many parts.
SALTS, HOT = 64, 1000
OFFSETS = tuple(int(x) for x in np.cumsum([0, *(1 << b for b in BITS)]))
CHUNK = 1 << 16
INPUTS, GATES, LEVELS = len(ORDERS) + 1, 64, 24
BLOCK = 16_384
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def profile(text: bytes) -> np.ndarray:
    """Square roots of the shares of the bytes in a text, A-Z counted as a-z."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n[97:123] += n[65:91]
    n[65:91] = 0
    return np.sqrt(n / max(1, n.sum()))


def nearest(profiles: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (profiles @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)


def profile_sums(texts: DataFrame, group: Callable[[np.ndarray], int]) -> tuple[np.ndarray, np.ndarray]:
    """How many texts (column t) each group of profiles has, and the sum of their profiles in 1 / UNIT: whole numbers, so the
    order in which tasks add them makes no difference. A row for each group reaches the driver."""
    schema = "k long, n long, s binary"

    def add(sums: dict[int, list], k: int, n: int, x: np.ndarray) -> None:
        own = sums.setdefault(k, [0, np.zeros(256, np.int64)])
        own[0] += n
        own[1] += x

    def out(sums: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], ["k", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for t in batch.column(0):
                p = profile(t.as_buffer())
                add(sums, group(p), 1, np.round(p * UNIT).astype(np.int64))
        yield out(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                add(sums, k, n, np.frombuffer(x, np.int64))
        yield out(sums)

    rows = sorted((r["k"], r["n"], bytes(r["s"])) for r in texts.select("t").mapInArrow(run, schema).repartition("k").mapInArrow(total, schema).collect())
    return np.array([[k, n] for k, n, _ in rows], np.int64).reshape(-1, 2), np.array([np.frombuffer(x, np.int64) for *_, x in rows], np.int64).reshape(-1, 256)


def fit_classes(texts: DataFrame) -> np.ndarray:
    """Centroids of the profiles of all texts (column t), each as often as it stands there. All texts are summed by cells of a
    grid over three fixed directions; the cells' means, weighted by their texts, give the start, and ROUNDS passes over all texts
    move each centroid to the mean of the texts that are nearest to it."""
    turn = np.random.default_rng(0).normal(size=(256, 3))

    def cell(p: np.ndarray) -> int:
        x, y, z = np.clip(np.floor(p @ turn * 4) + 8, 0, 15).astype(int).tolist()
        return x * 256 + y * 16 + z

    counts, sums = profile_sums(texts, cell)
    if not len(counts):
        return np.zeros((1, 256))
    n = counts[:, 1]
    points = sums / n[:, None] / UNIT
    centroids = points[[n.argmax()]]
    while len(centroids) < min(CLASSES, len(points)):  # the cells whose texts are farthest in all
        gap = np.min([((points - c) ** 2).sum(axis=1) for c in centroids], axis=0)
        centroids = np.vstack([centroids, points[(n * gap).argmax()]])
    for _ in range(20):
        own = nearest(points, centroids)
        centroids = np.array([np.average(points[own == k], axis=0, weights=n[own == k]) if (own == k).any() else c for k, c in enumerate(centroids)])
    for _ in range(ROUNDS):
        counts, sums = profile_sums(texts, lambda p, at=centroids: int(nearest(p[None], at)[0]))
        centroids[counts[:, 0]] = sums / counts[:, 1:] / UNIT
    return centroids


class Spelled:
    """Words as bytes with a space after each, and the contexts' hashes at each byte. A word's first byte is its class."""

    def __init__(self, keys: list[bytes]):
        words = [k[1:] for k in keys]
        kind = np.frombuffer(b"".join([k[:1] for k in keys]), np.uint8).astype(np.uint64)
        self.data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts = np.cumsum(length) - length
        first, kind = np.repeat(self.starts, length), np.repeat(kind, length)
        place = np.arange(len(self.data)) - first
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        self.hashes = []
        for k, order in enumerate(ORDERS):
            if order is None:
                h = (total[:-1] - total[first]) * down[first] + place.astype(np.uint64)
            else:
                h = np.zeros(len(self.data), np.uint64)
                for back in range(1, order + 1):
                    prior = np.zeros(len(self.data), np.uint64)
                    prior[back:] = self.data[:-back]
                    prior[place < back] = 0
                    h = h << np.uint64(8) | prior
            self.hashes.append((h * np.uint64(256) + kind + np.uint64((k + 1) * int(_B) % 2**64)) * _A)

    def bits(self, a: int, b: int):
        """For bytes a to b, at each of their bits: place of the bit, partial byte, bit, and each context's slot."""
        data = self.data[a:b].astype(np.int64)
        for i in range(8):
            node = (1 << i) | data >> (8 - i)
            salt = node.astype(np.uint64) * _B
            slots = [((h[a:b] ^ salt) * _C >> np.uint64(64 - n)).astype(np.int64) + o for h, n, o in zip(self.hashes, BITS, OFFSETS, strict=False)]
            yield i, node, data >> (7 - i) & 1, slots


def word_groups(words: list[bytes], counts: np.ndarray, most: int = BLOCK) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Consecutive words of about `most` bytes together, one word at least."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield words[i:j], counts[i:j]
        i = j


def predicted(n0: np.ndarray, n1: np.ndarray, with_seen: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Stretched prediction from counts, and the counts' sum as a power of two up to 7."""
    x = np.clip(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), -12, 12)
    return x, np.minimum(np.log2(n0 + n1 + 1), 7).astype(np.int64) if with_seen else None


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


class Mixer:
    """counts: 2 x slots (zeros, ones). Weights and refining map are learned by learn()."""

    def __init__(self, counts: np.ndarray | None, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.counts = counts
        self.weights = np.full((2, GATES, INPUTS), 0.15, np.float32) if weights is None else weights
        self.refine = np.zeros((2, 256 * LEVELS)) if refine is None else refine
        self.squares = np.full_like(self.weights, 1e-3)

    def inputs(self, place: int, bit: np.ndarray, slots: list[np.ndarray], own: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions with a bias, and the two gates. own: occurrences of the bit to take out of each context's counts."""
        x = np.empty((INPUTS, len(bit)), np.float32)
        seen = []
        for k, s in enumerate(slots):
            n0, n1 = self.counts[0, s], self.counts[1, s]
            n1 -= bit * own[k]
            n0 -= (1 - bit) * own[k]
            x[k], c = predicted(n0, n1, k >= 2)
            seen.append(c)
        x[-1] = 0.3
        return x, seen[4] * 8 + seen[3], seen[2] * 8 + place

    def packed(self) -> np.ndarray:
        """Every slot's prediction in 1/256 and how often it was seen, in one number."""
        out = np.empty(self.counts.shape[1], np.int32)
        for at in range(0, len(out), CHUNK):
            x, seen = predicted(*self.counts[:, at : at + CHUNK], True)
            out[at : at + CHUNK] = (np.round(x * 256).astype(np.int32) << 3) | seen.astype(np.int32)
        return out

    @staticmethod
    def unpacked(table: np.ndarray, place: int, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [table[s] for s in slots]
        x = np.full((INPUTS, len(slots[0])), 0.3, np.float32)
        for k, v in enumerate(got):
            np.multiply(v >> 3, np.float32(1 / 256), out=x[k])
        return x, (got[4] & 7) * 8 + (got[3] & 7), (got[2] & 7) * 8 + place

    def mix(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        s = np.einsum("kn,nk->n", x, self.weights[0][g] + self.weights[1][h])
        return 1 / (1 + np.exp(-np.clip(s, -14, 14)))

    def cell(self, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        return node * LEVELS + np.clip((stretch(p) + 12).astype(np.int64), 0, LEVELS - 1)

    def log2_probs(self, words: list[bytes], table: np.ndarray) -> np.ndarray:
        """log2 of each word's probability. table: packed()."""
        out = []
        for some, _ in word_groups(words, np.zeros(len(words))):
            w = Spelled(some)
            total = np.zeros(len(w.data))
            for place, node, bit, slots in w.bits(0, len(w.data)):
                p = self.mix(*self.unpacked(table, place, slots)).astype(np.float64)
                at = self.cell(node, p)
                n0, n1 = self.refine[0, at], self.refine[1, at]
                p = (p + (n1 + 32 * p) / (n0 + n1 + 32)) / 2
                total += np.log2(np.where(bit == 1, p, 1 - p))
            out.append(np.add.reduceat(total, w.starts))
        return np.concatenate(out) if out else np.zeros(0)

    def learn(self, words: list[bytes], counts: np.ndarray, rate: float = 0.05) -> None:
        """One pass, a step for each block and bit; a word weighs as often as it was seen."""
        for some, n in word_groups(words, counts):
            w = Spelled(some)
            own = [1.0] * len(ORDERS)
            weight = np.repeat(n, np.diff(np.r_[w.starts, len(w.data)])).astype(np.float64)
            for place, node, bit, slots in w.bits(0, len(w.data)):
                x, g, h = self.inputs(place, bit, slots, own)
                p = self.mix(x, g, h)
                at = self.cell(node, p)
                for v in (0, 1):
                    self.refine[v] += np.bincount(at, weight * (bit == v), self.refine.shape[1])
                err = (bit - p) * weight
                for which, gate in ((0, g), (1, h)):
                    seen = np.bincount(gate, weight, GATES)
                    step = np.stack([np.bincount(gate, err * x[k], GATES) for k in range(INPUTS)], axis=1) / np.maximum(seen, 1)[:, None]
                    self.squares[which] += step**2
                    self.weights[which] += rate * step / np.sqrt(self.squares[which])


def count_words(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """docs (t binary, learn boolean) to (word, c, c_all, lead): words with their class before them, how often each (and
    the end) occurs in rows to learn from, 0 where only in others; c_all over all classes; one lead for each plain word."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out():
            zero = [w for w in seen[0] if w not in seen[1]]
            yield pa.RecordBatch.from_arrays([pa.array([*seen[1], *zero], pa.binary()), pa.array([*seen[1].values(), *[0] * len(zero)], pa.int64())], schema=schema)

        for batch in batches:
            for t, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, c = t.lower(), seen[bool(learn)]
                kind = bytes([65 + int(nearest(profile(low)[None], centroids)[0])])
                c.update([kind + w for w in low.split()])
                c[kind + END] += 1
            if len(seen[0]) + len(seen[1]) > MEMO_WORDS:
                yield from out()
                seen[0].clear()
                seen[1].clear()
        yield from out()

    counts = docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    plain = Window.partitionBy(F.expr("substring(word, 2)"))
    return counts.withColumns({"c_all": F.sum("c").over(plain), "lead": F.col("word") == F.min("word").over(plain)})


def count_contexts(words: DataFrame) -> np.ndarray:
    """2 x slots, summed over tasks in chunks of slots; the tables' size is fixed."""
    total = OFFSETS[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, zip_ = np.zeros((2, total), np.int64), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for some, n in word_groups(batch.column(0).to_pylist(), batch.column(1).to_numpy(), 4 * BLOCK):
                w = Spelled(some)
                length = np.diff(np.r_[w.starts, len(w.data)])
                weight = np.repeat(n, length)
                for _, _, bit, slots in w.bits(0, len(w.data)):
                    for s in slots:
                        np.add.at(table.reshape(-1), s + bit * total, weight)
        chunks = [c for c in range(-(-total // CHUNK)) if table[:, c * CHUNK : (c + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([zip_.compress(table[:, c * CHUNK : (c + 1) * CHUNK].tobytes()) for c in chunks], pa.binary())], ["chunk", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for c, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(unzip.decompress(z), np.int64)
                sums[c] = sums[c] + got if c in sums else got
        zip_ = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zip_.compress(x.tobytes()) for x in sums.values()], pa.binary())], ["chunk", "blob"])

    table, unzip = np.zeros((2, total), np.float32), zstandard.ZstdDecompressor()
    for r in words.mapInArrow(count, "chunk long, blob binary").repartition("chunk").mapInArrow(add, "chunk long, blob binary").toLocalIterator():
        table[:, r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(unzip.decompress(bytes(r["blob"])), np.int64).reshape(2, -1)
    return table


def learn(words: DataFrame, counts: np.ndarray) -> Mixer:
    """Tasks learn over their words; weights are averaged by the words seen, maps are summed."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = Mixer(shared.value), 0
        for batch in batches:
            m.learn(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            seen += batch.num_rows
        flat = np.r_[m.weights.reshape(-1) * seen, m.refine.reshape(-1), seen]
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at], pa.float64())], ["i", "x"])

    got = words.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    shared.destroy()
    start = Mixer(counts)
    n = start.weights.size
    flat = np.zeros(n + start.refine.size + 1)
    flat[got["i"].to_numpy(int)] = got["x"].to_numpy(float)
    if not flat[-1]:
        return start
    return Mixer(counts, (flat[:n] / flat[-1]).reshape(start.weights.shape).astype(np.float32), flat[n:-1].reshape(start.refine.shape))


def dictionary(words: DataFrame) -> dict[int, tuple[float, float]]:
    """For each class (its byte): the probability of a word that was seen elsewhere too, and the class's tokens. Learned from
    the counts, each token's own occurrence taken out; a row for each class goes to the driver."""
    rows = words.where("c > 0").groupBy(F.expr("substring(word, 1, 1)").alias("k")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("again")).collect()
    return {bytes(r["k"])[0]: ((r["again"] + 0.4) / (r["n"] + 0.8), float(r["n"])) for r in rows}


def whole(keys: list[bytes], counts: np.ndarray, log2_spelled: np.ndarray, shares: dict[int, tuple[float, float]]) -> np.ndarray:
    """log10 of the words' probabilities: a bit for the class's dictionary or spelling, summed over both ways."""
    got = np.array([shares.get(k[0], (0.0, 1.0)) for k in keys]).reshape(-1, 2)
    with np.errstate(divide="ignore"):
        listed, spelled = np.log(got[:, 0] * counts / got[:, 1]), np.log1p(-got[:, 0]) + log2_spelled * np.log(2)
    return np.logaddexp(listed, spelled) / np.log(10)


def score(docs: DataFrame, learn_from, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, n_tokens, n_known, train_tokens, base_score, score (both log10), n_bytes (of the tokens as spelled)
    and bits_per_byte for each row. learn_from: a condition on docs; rows where it is null are not learned from."""
    spark = docs.sparkSession
    names = [doc_id, *keep]
    rows = docs.select(*names, raw_text(F.col(text)).alias("_t"), F.coalesce(learn_from, F.lit(False)).alias("_learn"))
    plain = rows.select(F.col("_t").alias("t"), F.col("_learn").alias("learn"))
    centroids = fit_classes(plain.where("learn").select("t"))
    words = materialize(count_words(plain, centroids), "words")
    total = words.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("lead") & (F.col("c_all") > 0), 1).otherwise(0)).alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    floor = float(np.log10(max(n + 0.5 * (v + 1), 0.5)))
    base = lambda c: np.log10(c + 0.5) - floor

    kinds = [bytes([65 + k]) for k in range(len(centroids))]
    top = words.where("c > 0").orderBy(F.desc("c"), "word").limit(TOP).select("word", "c", "c_all").toPandas()
    common, seen = [bytes(w) for w in top["word"]], top["c_all"].to_numpy(np.int64)
    ends = {bytes(r["word"]): (r["c"], r["c_all"]) for r in words.where(F.expr("substring(word, 2)") == END).select("word", "c", "c_all").collect()}  # one for each class
    share = np.array([ends.get(k + END, (0, 0))[0] + 1.0 for k in kinds])
    share = np.log10(share / share.sum())
    for k in kinds:
        if k + END not in set(common):
            common, seen = [*common, k + END], np.r_[seen, max((c for _, c in ends.values()), default=0)]
    known = words.where("c > 0").select("word", "c")
    counts = count_contexts(known)
    mixer = learn(known, counts)
    listed_share = dictionary(words)
    packed = mixer.packed()
    mixer.counts = counts = None  # the driver needs them no longer
    lengths = np.array([len(w) for w in common])
    own = dict(zip([bytes(w) for w in top["word"]], top["c"].tolist(), strict=True))
    counted = np.array([own.get(w, 0) for w in common])
    table = np.stack([seen > 0, base(seen), whole(common, counted, mixer.log2_probs(common, packed), listed_share), lengths], axis=1)
    sent = spark.sparkContext.broadcast(({w: i for i, w in enumerate(common)}, table))
    model = spark.sparkContext.broadcast((packed, mixer.weights, mixer.refine))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, *rest = model.value
        m = Mixer(None, *rest)
        for batch in batches:
            c = batch.column(2).to_numpy()
            some = batch.column(0).to_pylist()
            got = [pa.array(c > 0), pa.array(base(c)), pa.array(whole(some, batch.column(1).to_numpy(), m.log2_probs(some, table), listed_share))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *got], ["word", "known", "base", "lp"])

    keyed = rows.withColumn("_key", F.xxhash64("_t"))
    jumps = phrases.foretold(keyed.select(F.col("_t").alias("t"), F.col("_key").alias("key"), F.col("_learn").alias("learn")))
    # texts that over one row in HOT holds, fewer than HOT, are dealt to SALTS parts
    per_text = keyed.groupBy("_key").agg(F.count("*").alias("c"))
    hot = [r["_key"] for r in per_text.where(F.col("c") > max(1000, keyed.count() / HOT)).select("_key").collect()]
    salted = keyed.withColumn("_salt", F.when(F.col("_key").isin(hot), F.pmod(F.xxhash64(*names, F.spark_partition_id()), F.lit(SALTS))).otherwise(0) if hot else F.lit(0).cast("long"))
    parts_of = F.when(F.col("key").isin(hot), F.lit(SALTS)).otherwise(1) if hot else F.lit(1)
    jumps = jumps.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), (parts_of - 1).cast("long")))).withColumnRenamed("key", "_k")
    same = (F.col("_key") == F.col("_k")) & (F.col("_learn") == F.col("learned")) & (F.col("_salt") == F.col("_s"))
    joined = salted.join(jumps, same, "left").select(*names, "_t", "_learn", "_key", F.coalesce("jump_score", F.lit(0.0)).alias("_jump"), "skip")

    def make():
        (place, values), k = sent.value, len(names)
        get = place.get

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            source, word, out = [], [], []
            for i, (t, jump, skip) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 3).to_pylist(), batch.column(k + 4).to_pylist(), strict=True)):
                low = t.lower()
                own = int(nearest(profile(low)[None], centroids)[0])
                split = low.split()
                tokens = [kinds[own] + w for w in split]
                gone: list[bytes] = []
                if skip:  # words of foretold phrases: they count as tokens, but cost nothing more
                    parts, rest = phrases.phrase_counts(split, Step([low]).hashes), []
                    told = set(skip)
                    for j, part in enumerate(parts):
                        (gone if j in told else rest).extend(tokens[part])
                    tokens = rest
                found = list(map(get, tokens))
                rare = [w for w, j in zip(tokens, found, strict=True) if j is None]
                if rare:
                    found = [j for j in found if j is not None]
                found.append(place[kinds[own] + END])
                got = values[found].sum(axis=0).tolist()
                got[2] += share[own] + jump
                told_at = [get(w) for w in gone]
                told_rare = [w for w, j in zip(gone, told_at, strict=True) if j is None]
                told_at = [j for j in told_at if j is not None]
                more = values[told_at].sum(axis=0) if told_at else np.zeros(4)
                source.append(i)
                word.append(None)
                out.append((1, len(found) + len(told_at), got[0] + float(more[0]), got[1] + float(more[1]), got[2], got[3] + float(more[3]), 1))
                for told, some in ((0, rare), (1, told_rare)):
                    for w, n in Counter(some).items():
                        source.append(i)
                        word.append(w)
                        out.append((0, n, 0.0, 0.0, 0.0, float(n * len(w)), 1 - told))
            cols = list(zip(*out, strict=True))
            form = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
            at = pa.array(source)
            new = [pa.array(word, pa.binary()), *(pa.array(c, t) for c, t in zip(cols, form, strict=True))]
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:k]), batch.column(k + 2).take(at), *new], [*names, "_key", "word", "one", "n", "top_known", "top_base", "top_lp", "size", "paid"])

        return step

    schema = out_schema(docs, names, "_key long, word binary, one long, n long, top_known double, top_base double, top_lp double, size double, paid long")
    parts = map_arrow(joined, schema, make, len(names))
    scored = words.select("word", "c", "c_all").mapInArrow(score_words, "word binary, known boolean, base double, lp double").withColumnRenamed("word", "w")
    spelled = F.coalesce(F.col("word"), F.concat(F.lit("\n").cast("binary"), F.xxhash64(*names, "_key").cast("string").cast("binary")))  # a part without a word has a key that no word has
    both = parts.withColumn("word", spelled).join(scored, F.col("word") == F.col("w"), "left")
    none = F.lit(0.0)
    group = [*names, "_key"]
    sums = both.groupBy(*group).agg(
        F.sum("one").alias("rows"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.col("top_known") + F.when(F.col("known"), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("top_base") + F.coalesce(F.col("base") * F.col("n"), none)).alias("base_score"),
        F.sum(F.col("top_lp") + F.coalesce(F.col("lp") * F.col("n") * F.col("paid"), none)).alias("score"),
        F.sum("size").alias("n_bytes"),
    )
    # equal rows came together: each gets its share back
    each = sums.select(*names, F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_i"), *((F.col(c) / F.col("rows")).alias(c) for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")))
    out = each.select(*names, F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.col("n_bytes").cast("long").alias("n_bytes"))
    return out.withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes"))

"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Training takes a bounded, documented sample: up to PER_CLASS labelled texts of each class, those with the least hash of
their id among texts of at most SAMPLE_BYTES; so the index has a size bound too. Every word of every example is a term. A
term's weight is its TF-IDF times its contrast, between FLOOR and 1: how sure its share differs between the classes. No
term is left out, of examples, of texts or of their norms; words that no example has count in a text's norm as terms
seen in no example.

The index is block-max inverted lists: a term's postings are cut at the borders of blocks of examples, and each piece
holds its largest weight. The blocks with a text's largest bounds are searched first, then all that may still hold a nearer
example, so the neighbours are exact. Votes weigh by squared cosine and by how much rarer each class is in all training
labels than in the sample, and pull to the labels' share. The sample's own votes, each without itself, calibrate them: a
logistic curve with two parameters makes the score. The neighbours' ids are the evidence.

Null and empty texts have no neighbour and score the labels' share. Very long texts are scored whole. Equal cosines are
taken in the order of the index, which the sample fixes. Labels that are null or not 0 or 1 teach nothing; an id that is
labelled twice counts once, as 1 if any label is; an id with several texts may give an example for each, equal rows one. With labels of one
class or none, scores are constant. Repeated rows get equal scores. An empty table gives an empty result. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, map_arrow, materialize, out_schema, raw_text

PER_CLASS, SAMPLE_BYTES = 2048, 1 << 16
#: Chosen by cross-validation over the four training folds, held-out rows unseen.
FLOOR, DOUBT, NEIGHBOURS, PULL = 0.06, 60.0, 30, 0.1
BLOCK, FIRST_BLOCKS, DENSE, TOGETHER = 64, 4, 16, 64
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: bytes) -> list[str]:
    return _WORDS(text.decode("utf-8", "replace").lower())


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of so many from each start, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Vocabulary:
    """Terms with their weights; the last weight is that of a term that no example has."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.at = {t: i for i, t in enumerate(terms)}
        self.weights = weights

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known terms of the texts as text, term and the term's weight in the text's unit vector over all its terms."""
        get, none = self.at.get, len(self.weights) - 1
        counts = [Counter(words_of(t)) for t in texts]
        n = np.fromiter(map(len, counts), np.int64, len(texts))
        term = np.fromiter((get(w, none) for c in counts for w in c), np.int64, int(n.sum()))
        q = (1 + np.log(np.fromiter((x for c in counts for x in c.values()), float, len(term)))) * self.weights[term]
        text = np.repeat(np.arange(len(texts)), n)
        q /= np.sqrt(np.maximum(np.bincount(text, q**2, len(texts)), 1e-300))[text]
        known = term != none
        return text[known], term[known], q[known]


class Index:
    """Examples (unit vectors as terms and weights, a vote and an id each) in block-max inverted lists; lists with over
    1 in DENSE of the examples are kept as rows of a matrix, block by block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], votes: np.ndarray, ids: np.ndarray, n_terms: int):
        heaviest = [int(at[w.argmax()]) if len(at) else -1 for at, w in vectors]
        order = np.lexsort((np.arange(len(vectors)), heaviest)) if vectors else np.zeros(0, np.int64)  # like beside like: sharper bounds
        self.votes, self.ids, self.blocks = votes[order], ids[order], -(-len(order) // BLOCK)
        sizes = np.array([len(vectors[i][0]) for i in order], np.int64)
        term, weight = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)]), np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(order)), sizes)
        long = np.flatnonzero(np.bincount(term, minlength=n_terms) * DENSE > max(len(order), DENSE))
        self.row = np.full(n_terms, -1)
        self.row[long] = np.arange(len(long))
        self.rows = np.zeros((len(long), self.blocks * BLOCK), np.float32)
        own = self.row[term]
        self.rows[own[own >= 0], example[own >= 0]] = weight[own >= 0]
        self.row_most = self.rows.reshape(len(long), self.blocks, BLOCK).max(axis=2)
        by = np.flatnonzero(own < 0)
        by = by[np.argsort(term[by], kind="stable")]
        term, self.example, self.weight = term[by], example[by].astype(np.int32), weight[by].astype(np.float32)
        block = self.example // BLOCK
        piece = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.block, self.posting = block[piece].astype(np.int32), np.r_[piece, len(term)]
        self.most = np.maximum.reduceat(self.weight, piece) if len(piece) else np.zeros(0, np.float32)
        self.first = np.searchsorted(term[piece], np.arange(n_terms + 1))  # pieces of each term

    def nearest(self, n: int, text: np.ndarray, term: np.ndarray, q: np.ndarray, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the nearest examples with a positive cosine, for n texts as Vocabulary.vectors() gives them.
        but: for each text, the id of an example to leave out."""
        row = self.row[term]
        wide = np.zeros((n, len(self.rows)), np.float32)
        wide[text[row >= 0], row[row >= 0]] = q[row >= 0]
        sims = (wide @ self.rows).reshape(n, self.blocks, BLOCK).astype(float)  # of the long lists alone
        short = row < 0
        text, term, q = text[short], term[short], q[short]
        sizes = self.first[term + 1] - self.first[term]
        piece, text, q = spread(self.first[term], sizes), np.repeat(text, sizes), np.repeat(q, sizes)
        at = text * self.blocks + self.block[piece]
        bounds = sims.max(axis=2) + np.bincount(at, q * self.most[piece], n * self.blocks).reshape(n, self.blocks) + 1e-6  # the sums' own rounding
        last, done = min(FIRST_BLOCKS, self.blocks), np.zeros((n, self.blocks), bool)
        np.put_along_axis(done, np.argsort(-bounds, axis=1, kind="stable")[:, :last], True, axis=1)
        self._add(sims, at, piece, q, done)
        first = np.where(done[:, :, None], sims, 0.0).reshape(n, -1)
        out, k = [], min(NEIGHBOURS + (but is not None), first.shape[1])  # one more where one may be left out
        low = np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k]
        more = (bounds > low[:, None]) & ~done
        self._add(sims, at, piece, q, more)
        sims = np.where((done | more)[:, :, None], sims, 0.0).reshape(n, -1)
        low = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        for i in range(n):
            own = np.flatnonzero((sims[i] >= low[i]) & (sims[i] > 1e-9))
            if but is not None:
                own = own[self.ids[own] != but[i]]
            own = own[np.lexsort((own, -sims[i, own]))[:NEIGHBOURS]]
            out.append((own, sims[i, own]))
        return out

    def _add(self, sims: np.ndarray, at: np.ndarray, piece: np.ndarray, q: np.ndarray, live: np.ndarray) -> None:
        """Adds the short lists' postings in the live blocks (texts x blocks)."""
        mine = live.reshape(-1)[at]
        start = self.posting[piece[mine]]
        count = self.posting[piece[mine] + 1] - start
        k = spread(start, count)
        place = np.repeat(at[mine], count) * BLOCK + self.example[k] % BLOCK
        sims += np.bincount(place, self.weight[k] * np.repeat(q[mine], count), sims.size).reshape(sims.shape)

    def votes_for(self, n: int, text: np.ndarray, term: np.ndarray, q: np.ndarray, prior: float, but: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
        """For each text, the share of the weighted votes for 1, and the neighbours' places."""
        out = []
        for found, sims in self.nearest(n, text, term, q, but):
            w = sims**2 * np.abs(self.votes[found])
            out.append((float((w[self.votes[found] > 0].sum() + PULL * prior) / (w.sum() + PULL)), found))
        return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def curve(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve from the votes' logits to the labels, by Newton steps with a small pull to the votes themselves."""
    x, b = np.stack([logit(votes), np.ones(len(votes))]), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        gradient = x @ (weight * (y - p)) - (b - [1.0, 0.0])
        b = b + np.linalg.solve((x * weight * p * (1 - p)) @ x.T + np.eye(2), gradient)
    return float(max(b[0], 0.0)), float(b[1])


class Model:
    def __init__(self, vocabulary: Vocabulary | None, index: Index | None, prior: float, slope: float = 1.0, level: float = 0.0):
        self.vocabulary, self.index, self.prior, self.slope, self.level = vocabulary, index, prior, slope, level

    def score(self, texts: list[bytes]) -> list[tuple[float, list[int]]]:
        if self.index is None:
            return [(self.prior, [])] * len(texts)
        out = []
        for i in range(0, len(texts), TOGETHER):
            some = texts[i : i + TOGETHER]
            for share, found in self.index.votes_for(len(some), *self.vocabulary.vectors(some), self.prior):
                p = float(1 / (1 + np.exp(-(self.slope * logit(share) + self.level))))
                out.append((p, self.index.ids[found].tolist()) if len(found) else (self.prior, []))
        return out


def weigh(d0: np.ndarray, d1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Weights of terms in d0 of n0 and d1 of n1 examples, and of one in none."""
    d, n = d0 + d1, n0 + n1
    p = np.minimum(d / n, 1 - 0.5 / n)
    z2 = (d1 / n1 - d0 / n0) ** 2 / (p * (1 - p) * (1 / n0 + 1 / n1))
    return np.r_[np.log((n + 1) / d) * np.maximum(FLOOR, z2 / (z2 + DOUBT)), np.log(n + 1) * FLOOR]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model from docs and labels (doc_id, label)."""
    spark = docs.sparkSession
    integral(docs, doc_id)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = share.get(1, 0) / max(1, sum(share.values()))
    if len(share) < 2:
        return Model(None, None, prior)
    rows = docs.select(F.col(doc_id).alias("id"), raw_text(F.col(text)).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("t"))
    keys = rows.select("id", "h").join(known, "id").distinct()
    picked = [keys.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", "h").limit(PER_CLASS) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # 2 x PER_CLASS rows of three numbers at most are broadcast
    sample = materialize(rows.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h", "y").agg(F.min("t").alias("t")), "toxic-sample")

    def terms(batches):
        for batch in batches:
            seen: Counter = Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((w, y) for w in set(words_of(t)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "y", "n"])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(None, None, prior)
    counts = sample.select("t", "y").mapInArrow(terms, "term string, y int, n long").groupBy("term").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"d{y}") for y in (0, 1))).toArrow()
    counts = counts.sort_by("term")
    names = counts.column("term").to_pylist()
    weights = weigh(counts.column("d0").to_numpy().astype(float), counts.column("d1").to_numpy().astype(float), n0, n1)
    del counts
    shared = spark.sparkContext.broadcast((names, weights))  # both are bounded by PER_CLASS and SAMPLE_BYTES, as is the index

    def vectors(batches):
        vocabulary = Vocabulary(*shared.value)
        for batch in batches:
            text, term, q = vocabulary.vectors(batch.column(0).to_pylist())
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            at, w = ([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (term.astype(np.int32), q.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.binary()), pa.array(w, pa.binary())], ["id", "y", "at", "w"])

    found = sample.select("t", F.col("id").cast("long").alias("id"), "y").mapInArrow(vectors, "id long, y int, at binary, w binary")
    got = sorted(found.collect(), key=lambda r: (r["id"], bytes(r["at"]), bytes(r["w"])))
    y = np.array([r["y"] for r in got])
    votes = np.where(y == 1, prior / n1, -(1 - prior) / n0) * (n0 + n1)
    index = Index([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["w"], np.float32)) for r in got], votes, np.array([r["id"] for r in got], np.int64), len(weights))
    del got
    sent = spark.sparkContext.broadcast((names, weights, index))

    def own_votes(batches):
        terms, weights, index = sent.value
        vocabulary = Vocabulary(terms, weights)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                v = index.votes_for(part.num_rows, *vocabulary.vectors(part.column(0).to_pylist()), prior, part.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in v], pa.float64()), part.column(2)], ["vote", "y"])

    own = sample.select("t", F.col("id").cast("long").alias("id"), "y").mapInArrow(own_votes, "vote double, y int").toArrow().sort_by([("vote", "ascending"), ("y", "ascending")])
    y = own.column("y").to_numpy().astype(float)
    slope, level = curve(own.column("vote").to_numpy(), y, np.where(y == 1, prior / n1, (1 - prior) / n0) * (n0 + n1))
    sent.destroy()
    shared.destroy()
    return Model(Vocabulary(names, weights), index, prior, slope, level)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, predicted and evidence (the nearest examples' ids) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = own.score(batch.column(len(names)).to_pylist())
            new = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, "score", "predicted", "evidence"])

        return step

    schema = out_schema(docs, names, "score double, predicted int, evidence array<long>")
    return map_arrow(docs.select(*names, raw_text(F.col(text)).alias("_t")), schema, make, len(names))

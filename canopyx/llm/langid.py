"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is given. Each language has a probability for each piece; the probability of a word
is the sum over all ways to cut it into pieces, by a forward recursion over its characters: plain sums for words of up to
SHORT characters, many words at once, and rescaled ones for longer words, whatever their length. Piece probabilities are
learned by expectation-maximisation over all training words, counted by language: the E-step (forward-backward) runs
in tasks over distinct words, the M-step is a sum by language and piece, so what reaches the driver is bounded by
languages x vocabulary. A document's score is the sum over its words plus the language's log prior.

Words are a letter (Unicode category L) and the letters and marks that follow it, lower-cased. Null texts and texts
without a letter are `und` with score 0. Rows with a null language teach nothing. With no training rows every text is
`und`. An empty table gives an empty result. Repeated rows count each time. Very long texts and words count whole, in time
proportional to their length. Ties go to the alphabetically first language. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, out_schema, raw_text

UNKNOWN = "und"
#: Characters up to which a word's sums cannot underflow; longer ones are rescaled on the way.
SHORT = 32
#: Probability of a character outside the vocabulary.
FLOOR = 1e-7
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_PIECE = regex.compile(r"[\p{L}\p{M}]+").fullmatch
#: Distinct words that a task remembers before it starts anew.
MEMO_WORDS = 500_000


def vocabulary(model_file: str) -> list[str]:
    """Pieces of a sentencepiece model made only of letters, lower-cased, and without the mark for a word's start."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {m.id_to_piece(i).lstrip("▁").lower() for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    return sorted(filter(_PIECE, pieces))


def words_of(text: bytes) -> list[str]:
    return _WORDS(text.decode("utf-8", "replace").lower())


class Lattice:
    """Sums over segmentations for many words at once. prob: pieces x languages; a single character outside the
    vocabulary is a piece of its own with probability floor."""

    def __init__(self, pieces: list[str], prob: np.ndarray, floor: float = FLOOR):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        n = prob.shape[1]
        self.prob = np.vstack([prob, np.full((1, n), floor), np.zeros((1, n))])
        self.alone, self.none = len(pieces), len(pieces) + 1

    def pairs(self, n: int) -> list[tuple[int, int]]:
        """Places of the pieces in a word of n characters, by their end."""
        return [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]

    def pieces_at(self, words: list[str], pairs: list[tuple[int, int]]) -> np.ndarray:
        """Pairs x words: the piece at each place."""
        get, none = self.index.get, self.none
        k = np.array([[get(w[i:j], none) for i, j in pairs] for w in words], np.int32).T
        for row, (i, j) in zip(k, pairs, strict=True):
            if j == i + 1:
                row[row == none] = self.alone
        return k

    def forward(self, n: int, pairs: list, k: np.ndarray, cols: slice) -> np.ndarray:
        """Positions x words x languages."""
        a = np.zeros((n + 1, k.shape[1], len(range(*cols.indices(self.prob.shape[1])))))
        a[0] = 1.0
        p = self.prob[:, cols]
        for row, (i, j) in zip(k, pairs, strict=True):
            a[j] += a[i] * p[row]
        return a

    def ending(self, word: str, j: int) -> tuple[slice, list[int]]:
        """The places where pieces that end at j start, and the pieces."""
        get, none = self.index.get, self.none
        i = max(0, j - self.longest)
        k = [get(word[x:j], none) for x in range(i, j)]
        if k[-1] == none:
            k[-1] = self.alone
        return slice(i, j), k

    def starting(self, word: str, i: int) -> tuple[slice, list[int]]:
        """The places where pieces that start at i end, and the pieces."""
        get, none = self.index.get, self.none
        j = min(len(word), i + self.longest)
        k = [get(word[i:x], none) for x in range(i + 1, j + 1)]
        if k[0] == none:
            k[0] = self.alone
        return slice(i + 1, j + 1), k

    def log_sums(self, word: str, cols: slice, back: bool = False) -> np.ndarray:
        """Logs of the forward sums (or backward ones), positions x languages, for words of any length. Sums within a piece's
        reach of each other differ by far less than what a float holds, so one scale for each step is enough."""
        p, n = self.prob[:, cols], len(word)
        out, last = np.zeros((n + 1, p.shape[1])), n if back else 0
        for j in range(n - 1, -1, -1) if back else range(1, n + 1):
            near, k = self.starting(word, j) if back else self.ending(word, j)
            out[j] = out[last] + np.log((np.exp(out[near] - out[last]) * p[k]).sum(axis=0))
            last = j
        return out

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Words x languages."""
        out = np.zeros((len(words), self.prob.shape[1]))
        for n, at, parts in by_length(words):
            if n > SHORT:
                out[at] = [self.log_sums(w, slice(None))[n] for w in parts]
                continue
            pairs = self.pairs(n)
            out[at] = np.log(self.forward(n, pairs, self.pieces_at(parts, pairs), slice(None))[n])
        return out

    def expect(self, words: list[str], counts: np.ndarray, col: int) -> np.ndarray:
        """Expected counts of the pieces in words seen so many times in one language."""
        total = np.zeros(len(self.prob))
        for n, at, parts in by_length(words):
            if n > SHORT:
                for x, w in zip(at.tolist(), parts, strict=True):
                    fore, back = (self.log_sums(w, slice(col, col + 1), b)[:, 0] for b in (False, True))
                    for j in range(1, n + 1):
                        near, k = self.ending(w, j)
                        np.add.at(total, k, np.exp(fore[near] + back[j] - fore[n]) * self.prob[k, col] * counts[x])
                continue
            pairs = self.pairs(n)
            k = self.pieces_at(parts, pairs)
            a, b = self.forward(n, pairs, k, slice(col, col + 1))[:, :, 0], np.zeros((n + 1, len(parts)))
            b[n] = 1.0
            p = self.prob[:, col]
            for row, (i, j) in zip(k[::-1], pairs[::-1], strict=True):
                b[i] += b[j] * p[row]
            scale = counts[at] / np.maximum(a[n], 1e-300)
            for row, (i, j) in zip(k, pairs, strict=True):
                total += np.bincount(row, a[i] * b[j] * p[row] * scale, len(total))
        return total[: self.alone]


def by_length(words: list[str], most: int = 2048):
    """(length, positions of the words, words): words of equal length, at most so many together."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for x, w in enumerate(words):
        at, parts = groups.setdefault(len(w), ([], []))
        at.append(x)
        parts.append(w)
    for n, (at, parts) in groups.items():
        for i in range(0, len(at), most):
            yield n, np.array(at[i : i + most]), parts[i : i + most]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word, n over all rows with a language; tasks add up before the shuffle."""

    def count(batches):
        seen: dict[str, Counter] = {}
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

        def out(l: str, c: Counter):
            return pa.RecordBatch.from_arrays([pa.array([l] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], schema=schema)

        for batch in batches:
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(l, Counter()).update(words_of(t))
                if len(seen[l]) > MEMO_WORDS:
                    yield out(l, seen.pop(l))
        for l, c in seen.items():
            yield out(l, c)

    rows = docs.where(F.col(lang).isNotNull()).select(raw_text(F.col(text)).alias("t"), F.col(lang).cast("string").alias("lang"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as said, so that the E-step's tasks are as many
    return rows.mapInArrow(count, "lang string, word string, n long").repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", rounds: int = 2, smooth: float = 0.05) -> tuple:
    """EM over all words of docs to (languages, pieces, piece probabilities, log priors). Languages are few by nature; their list goes to the driver."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, text, lang), "langid-words")
    known = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("l")).count().collect()
    langs = sorted(r["l"] for r in known)
    n_langs, at = len(langs), {x: i for i, x in enumerate(langs)}
    n_docs = np.zeros(n_langs)
    for r in known:
        n_docs[at[r["l"]]] = r["count"] + 1.0
    size = np.array([20.0 ** -len(p) for p in pieces])
    prob = np.repeat((size / size.sum())[:, None], n_langs, axis=1)
    for _ in range(rounds if n_langs else 0):
        shared = spark.sparkContext.broadcast((pieces, prob))

        def expect(frames, shared=shared):
            p, q = shared.value
            lattice, total = Lattice(p, q), np.zeros((len(p), n_langs))
            for frame in frames:
                for l, part in frame.groupby("lang"):
                    total[:, at[l]] += lattice.expect(part["word"].tolist(), part["n"].to_numpy(float), at[l])
            i, j = np.nonzero(total)
            yield pd.DataFrame({"piece": i, "l": j, "x": total[i, j]})

        got = counts.select("lang", "word", "n").mapInPandas(expect, "piece long, l long, x double").groupBy("piece", "l").agg(F.sum("x").alias("x")).toPandas()
        shared.destroy()
        total = np.full((len(pieces), n_langs), smooth)
        total[got["piece"].to_numpy(int), got["l"].to_numpy(int)] += got["x"].to_numpy(float)
        prob = total / total.sum(axis=0)
    discard(counts)
    return langs, pieces, prob, np.log(n_docs / max(n_docs.sum(), 1.0))


def predict(docs: DataFrame, model: tuple, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score (the posterior of lang_pred) for each row; the model is broadcast, its size is the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def make():
        langs, pieces, prob, prior = shared.value
        lattice, memo, rows = Lattice(pieces, prob), {}, [np.zeros((0, len(langs)))]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(memo) > MEMO_WORDS:
                memo.clear()
                rows[0] = rows[0][:0]
            texts = [words_of(t) for t in batch.column(len(names)).to_pylist()]
            new = list({w for t in texts for w in t if w not in memo})
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            rows[0] = np.vstack([rows[0], lattice.log_probs(new)])
            best, scores = [], []
            for words in texts:
                if not words or not langs:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = prior + rows[0][np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0)
                top = int(total.argmax())
                best.append(langs[top])
                scores.append(float(1 / np.exp(np.maximum(total - total[top], -700)).sum()))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

        return step

    schema = out_schema(docs, names, "lang_pred string, score double")
    return map_arrow(docs.select(*names, raw_text(F.col(text)).alias("_t")), schema, make, len(names))

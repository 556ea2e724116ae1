"""Contexts that cross words, for language-model scoring: which phrase follows a phrase.

A text is cut into phrases after each word whose hash is 0 modulo MEAN, so equal passages are cut alike wherever they stand.
The hash of a phrase is the context of a bit: whether the next phrase is the one that follows it elsewhere in the rows to
learn from (of several, that of the least hash; the text's own occurrence does not count). The bit's probability comes from
an adaptive table, chosen by how often the context was seen and by whether one phrase alone follows it. A text pays for each
such bit; the words of a phrase that the context foretold cost nothing more.

How it is spread: copies of a text that a task sees in one step are one text; successors are counted with partial sums and
joined back by the context, as a table that grows with the corpus. A context that many texts share is split by Spark where
its rows are too many for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps
from .substring import MAP_BYTES, Step, powers

MEAN = 8
#: Classes of a context's count (powers of two).
SEEN = 8


def phrase_ends(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places after the last word of each phrase, over texts of so many words one after the other."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    last = (hashes ^ hashes >> np.uint64(17)) % np.uint64(MEAN) == 0
    ends = np.cumsum(lengths)
    last[ends[lengths > 0] - 1] = True
    return np.flatnonzero(last) + 1


def phrase_counts(words: list[bytes], hashes: np.ndarray) -> list[slice]:
    """The phrases of one text."""
    ends = phrase_ends(hashes, np.array([len(words)])).tolist()
    return [slice(a, b) for a, b in zip([0, *ends][:-1], ends, strict=True)]


def follow(rows: DataFrame) -> DataFrame:
    """rows (t binary, key long, learn boolean) to (key, place, ctx, next, n): for each distinct text (by key) of a step its
    phrases but the first, with the hashes of the phrase before and of their own, and in how many rows to learn from it stands."""
    schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("ctx", pa.int64()), ("next", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 0, MAP_BYTES):
            key, at, back = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            n = np.bincount(back, batch.column(2).to_numpy(zero_copy_only=False)).astype(np.int64)
            s = Step([t.lower() for t in batch.column(0).take(pa.array(at)).to_pylist()])
            if not len(s.hashes):
                continue
            ends = phrase_ends(s.hashes, s.lengths)
            starts = np.r_[0, ends[:-1]]
            up, down = powers(len(s.hashes) + 1)
            total = np.zeros(len(s.hashes) + 1, np.uint64)
            np.cumsum(s.hashes * up[: len(s.hashes)], out=total[1:])
            own = (total[ends] - total[starts]) * down[starts]
            own ^= own >> np.uint64(29)
            text = s.owners()[starts]
            first = np.r_[True, text[1:] != text[:-1]]
            place = np.arange(len(starts)) - np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0))
            at = np.flatnonzero(~first)
            h = own.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[text[at]]), pa.array(place[at].astype(np.int32)), pa.array(h[at - 1]), pa.array(h[at]), pa.array(n[text[at]])], schema=schema)

    return rows.select("t", "key", "learn").mapInArrow(run, "key long, place int, ctx long, next long, n long")


def foretold(rows: DataFrame) -> DataFrame:
    """key, jump_score (log10 of the bits' probabilities) and skip (places of the phrases that their contexts foretold) of
    each distinct text with a phrase whose context says anything; a row for texts learned from and one for others (learned)."""
    entries = materialize(follow(rows), "phrases")
    table = entries.where("n > 0").groupBy(F.col("ctx").alias("k")).agg(F.sum("n").alias("total"), F.min("next").alias("lo"), F.max("next").alias("hi"))
    # a text that is learned from is scored without its own occurrence; one that stands in both parts is scored for both
    sides = F.array_compact(F.array(F.when(F.col("n") > 0, 1), F.lit(0)))
    seen = entries.join(table, F.col("ctx") == F.col("k")).withColumn("own", F.explode(sides)).withColumn("total", F.col("total") - F.col("own")).where("total > 0")
    guess = F.when((F.col("own") == 1) & (F.col("next") == F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
    hit = guess == F.col("next")
    state = F.least(F.floor(F.log2("total")), F.lit(SEEN - 1)) * 2 + (F.col("lo") == F.col("hi")).cast("int")
    seen = materialize(seen.select("key", "own", "place", hit.alias("hit"), state.cast("int").alias("state"), F.when(F.col("own") == 1, F.col("n")).otherwise(0).alias("n")), "foretold")
    sums = {r["state"]: (r["h"], r["t"]) for r in seen.where("own = 1").groupBy("state").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("h"), F.sum("n").alias("t")).collect()}
    p = [float((h + 0.4) / (t + 0.8)) for s in range(SEEN * 2) for h, t in (sums.get(s, (0, 0)),)]
    chance = F.element_at(F.array(*(F.lit(x) for x in p)), F.col("state") + 1)
    cost = F.log10(F.when(F.col("hit"), chance).otherwise(1 - chance))
    # copies of a text in several steps have equal rows but for n
    return seen.withColumn("cost", cost).groupBy("key", "own", "place").agg(F.first("cost").alias("cost"), F.first("hit").alias("hit")).groupBy("key", (F.col("own") == 1).alias("learned")).agg(F.sum("cost").alias("jump_score"), F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("place")))).alias("skip"))

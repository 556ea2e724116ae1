"""What a task holds at a time, measured in this process."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from canopyx.llm import mixing, substring


class _Task:
    """Stands for a frame and its session: keeps the function that a task would run."""

    sparkSession = sparkContext = property(lambda self: self)  # noqa: N815

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def select(self, *_):
        return self

    def repartitionById(self, *_):  # noqa: N802
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def _peak(run, batches) -> tuple[int, list[pa.RecordBatch]]:
    tracemalloc.start()
    out = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, out


def test_a_bucket_of_repeated_windows_is_held_by_window(spark):
    random = np.random.default_rng(0)
    texts = [b" ".join(b"%x" % x for x in random.integers(0, 1 << 30, 400)) for _ in range(300)]
    texts.append(texts[0][:2000])
    rows = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(range(301)), pa.array(texts, pa.binary())], ["id", "key", "t"])
    task = _Task()
    packed = list(substring.pack(task, np.zeros(1 << substring.SLOT_BITS, bool), 1).run(iter([rows.slice(k, 43) for k in range(0, 301, 43)])))
    peak, out = _peak(substring.resolve(task, 1).run, packed)
    words = sum(len(t.split()) for t in texts)
    found = {r["id"] for b in out for r in b.to_pylist()}
    assert found == {300}
    # a bucket's words are three times the texts', nine bytes each; the rest is in proportion to the windows
    assert peak < 120 * words, peak / words


def test_contexts_are_counted_by_small_groups_of_words(spark):
    random = np.random.default_rng(1)
    words = [b"A%x" % x for x in random.integers(0, 1 << 60, 60_000)]

    class Words(_Task):
        def repartition(self, _):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.runs = [*getattr(self, "runs", ()), run]
            return self

        def toLocalIterator(self):  # noqa: N802
            return iter(())

        collect = toLocalIterator

    task = Words()
    mixing.count_contexts(task)
    batches = [pa.RecordBatch.from_arrays([pa.array(words[k : k + 10_000], pa.binary()), pa.array([1] * 10_000)], ["word", "c"]) for k in range(0, 60_000, 10_000)]
    peak, _ = _peak(task.runs[0], batches)
    table = 2 * 8 * mixing.OFFSETS[-1]
    assert peak < table + (60 << 20), peak - table


def test_classes_are_fitted_to_all_texts(spark):
    """20,000 texts of a kind and 500 of another: all are summed, whatever their order and partitions."""
    rows = [(b"aaab" * (1 + k % 3) + b"%d" % k,) for k in range(20_000)] + [(b"zzzzzzzy",)] * 500
    frame = spark.createDataFrame(rows, "t binary")
    profiles = np.array([mixing.profile(t) for (t,) in rows])
    found = mixing.fit_classes(frame)
    own = mixing.nearest(profiles, found)
    again = np.array([profiles[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(found)])
    assert own[-1] not in own[:20_000] and abs(found[own[-1]] - profiles[-1]).max() < 1e-5
    counts, sums = mixing.profile_sums(frame, lambda p: 0)
    assert counts.tolist() == [[0, 20_500]] and abs(sums[0] / mixing.UNIT - profiles.sum(axis=0)).max() < 0.02
    assert len(found) <= mixing.CLASSES and abs(found - again).max() < 0.05
    assert (mixing.fit_classes(frame.repartition(7)) == found).all()
    assert (mixing.fit_classes(frame.limit(0)) == np.zeros((1, 256))).all()

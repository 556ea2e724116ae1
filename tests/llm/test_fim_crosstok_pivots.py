"""Fill-in-middle, tokenizer alignment and the pivot index against brute force and on awkward tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopyx.llm import bpe, crosstok, fim, packing, pivots
from canopyx.llm.common import materialize

SCHEMA = "doc_id long, text string, n int, form string, prefix string, output string, a_ids string, _t string, links string"


def some_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("ab C.\n é漢😀́\t1") for _ in range(n))
    texts = [make(rng.randint(1, 80)) for _ in range(60)] + ["", None, " ", "x<P>y", "a <S>", "<M>", "< P>", "<", "<S", "a" * 50_000, "😀" * 3001, "the cat sat on the mat " * 40, "the cat sat on the mat " * 40, "tab\there", "ｆｕｌｌ ﬁ", "x\x00y", "<|endoftext|> <s> <unk>", "▁ _", " " * 5000]
    return [*enumerate(texts), (3, texts[3]), (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "p", "o", "a", "t", "l") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected):
    assert collections.Counter(map(tuple, found)) == collections.Counter(map(tuple, expected))


def fill(i, t, split):
    t = t or ""
    cut = split(t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(cut)
    if not n or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return i, n, form, p, m, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", t


def test_fill_in_middle(docs, rows, empty):
    out = fim.transform(docs).select("doc_id", "n", "form", "prefix", "middle", "output", fim.restored(F.col("output"), F.col("form")))
    same(out.collect(), [fill(i, t, list) for i, t in rows])
    assert {r["form"] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    none = fim.transform(empty)
    assert none.columns == fim.transform(docs).columns and none.count() == 0


BOUNDARIES = {
    "word": r"(?<=[ \t-\r])(?=[^ \t-\r])",
    "line": r"(?<=\n)(?=.)",
    "sentence": r"(?<=[.!?][ \t-\r])(?=[^ \t-\r])",
    "subword": r"(?<=[ \t-\r])(?=[^ \t-\r])|(?<=[abé])(?=[C])|(?<=\D)(?=\d)|(?<=\d)(?=\D)",
}


@pytest.mark.parametrize("unit", BOUNDARIES)
def test_units(docs, rows, unit):
    split = lambda t: [x for x in re.split(BOUNDARIES[unit], t, flags=re.S)] if t else []
    some = docs.where("length(text) < 100 or text is null")
    out = fim.transform(some, unit=unit).select("doc_id", "n", "form", "prefix", "middle", "output", fim.restored(F.col("output"), F.col("form")))
    ok = [(i, t) for i, t in rows if t is None or len(t) < 100]
    same(out.collect(), [fill(i, t, split) for i, t in ok])


@pytest.fixture(scope="module")
def tokens():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        a = crosstok.ByteLevel(bpe.read_ranks(f.readlines()), public_tokenizers.PATTERN)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return a, crosstok.Pieces(f.read())


def aligned(rows):
    """Groups, links and tokens of each text by walking over its bytes, with the libraries named in the data's description."""
    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in visible} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible)}
    out = []
    for i, t in rows:
        a = left.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = right.encode(t or "") if t else []
        at = [bytes(back[c] for c in left.id_to_token(x)) for x in a]
        bt = [bytes([int(p[1:-1], 16)]) if right.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [right.id_to_piece(x)]]
        if not t or b"".join(at) != (" " + t).encode() or b"".join(bt) != (" " + t).encode():
            out.append((i, [], [], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, side))) for side in (at, bt)]
        groups, links, ga, gb, j = [], [], [], [], 0
        for k, x in enumerate(a):
            ga.append(x)
            while j < len(b) and ends[1][j] <= ends[0][k]:
                gb.append(b[j])
                j += 1
            if j and ends[1][j - 1] == ends[0][k]:
                links.append((x, b[j - 1]))
                groups.append((ga, gb))
                ga, gb = [], []
        out.append((i, a, b, groups, links))
    return out


def test_alignment(docs, rows, tokens, empty):
    own = aligned(rows)
    count = collections.Counter(x for r in own for x in r[4])
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    expected = []
    for i, a, b, groups, links in own:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expected.append((i, len(a), len(b), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if a else "", sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)))
    assert 0 < sum(not r[1] for r in own) < len(own)
    same(crosstok.score(docs, *tokens).collect(), expected)
    same(crosstok.score(docs, *tokens, most=0).collect(), expected)  # the pairs' counts meet the texts in a join
    assert len(count) <= crosstok.pair_bound(*(t.table() for t in tokens)) <= crosstok.MAX_PAIRS
    shown = {r["doc_id"]: r for r in crosstok.align(docs.where("doc_id is not null"), *tokens).collect()}
    for i, a, b, groups, _ in own:
        if i is not None:
            r = shown[i]
            assert r["a_ids"] == a and r["b_ids"] == b
            assert r["a_closes"] == list(itertools.accumulate(len(x) for x, _ in groups)) and r["b_closes"] == list(itertools.accumulate(len(y) for _, y in groups))
    assert crosstok.score(empty, *tokens).count() == crosstok.align(empty, *tokens).count() == 0


def test_intervals():
    rng = np.random.default_rng(2)
    for _ in range(200):
        total = rng.integers(1, 30)
        a, b = (np.sort(np.r_[rng.integers(0, total, rng.integers(0, 12)), total]) for _ in "ab")  # ends may repeat: tokens without bytes
        ends, i, j = crosstok.intervals(a, b)
        for e, x, y in zip(ends, i, j, strict=True):
            assert x == next(k for k, v in enumerate(a) if v >= e) and y == next(k for k, v in enumerate(b) if v >= e)
        shared = crosstok.shared_ends(a, b)
        assert shared.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        found = set(zip(*(v.tolist() for v in crosstok.products(a, b, shared)), strict=True))
        assert found == {(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]}


def test_long_pieces():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoder = packing.Encoder(bpe.read_ranks(f.readlines()), public_tokenizers.PATTERN)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 5000 + "x", "ab" * 3000):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(encoder.ids(" " * 400_000)) > 0  # tiktoken alone fails here


VECTORS = "vec_id long, embedding array<float>, label int, row long, key string, unit string, node long, size long, low long"


def some_vectors():
    rng = np.random.default_rng(4)
    around = lambda centre, share: centre + share * np.linalg.norm(centre) * (g := rng.normal(size=16)) / np.linalg.norm(g)
    out, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            centre = rng.normal(size=16)
            out += [(around(centre, s), label) for s in (0, 0.1, 0.25, 0.37, 0.45)[: rng.integers(1, 6)]]
    centre = rng.normal(size=16)
    out += [(around(centre, 0.2), 2) for _ in range(90)] + [(centre, 2)] * 40  # a crowd, and copies
    rows = [(k, v.tolist(), label) for k, (v, label) in enumerate(out)]
    k = len(rows)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [1e38] * 16, [1e-38] * 16, [1.0] * 7, [2.0] * 7, [3.0] * 16]
    rows += [(k + i, v, 0) for i, v in enumerate(odd)]
    return [*rows, (3, rows[3][1], rows[3][2]), (None, rows[0][1], 0), (None, [1.0, -1.0] * 8, 0), (None, rows[-1][1], None)]


def brute(rows, cosine):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    link = [set() for _ in rows]
    for x in range(n):
        for y in range(x):
            if good[x] and good[y] and rows[x][2] == rows[y][2] and len(rows[x][1]) == len(rows[y][1]):
                a, b = (np.array(np.array(rows[k][1], np.float32), np.float64) for k in (x, y))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    link[x].add(y)
                    link[y].add(x)
    out = []
    for x in range(n):
        seen, todo = {x}, [x]
        while todo:
            for y in link[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        low = min((rows[y][0] for y in seen if rows[y][0] is not None), default=None)
        out.append((rows[x][0], len(link[x]), low, rows[x][0] == low))
    return out


def test_pivot_index(spark, monkeypatch):
    rows = some_vectors()
    table = spark.createDataFrame([(*r, 1, "k", "u", 2, 3, 4) for r in rows], VECTORS).repartition(3)
    expected = brute(rows, 0.93)
    assert max(r[1] for r in expected) > 100
    monkeypatch.setattr(pivots, "BLOCK", 16)  # a crowded signature is several blocks
    found = pivots.near_duplicates(table).collect()
    missed = sum((collections.Counter(expected) - collections.Counter(map(tuple, found))).values())
    assert sum(r["n_links"] for r in found) <= sum(r[1] for r in expected) and missed <= 0.02 * len(rows)
    # with every pair a candidate the result is exact
    monkeypatch.setattr(pivots, "SHARED", 1)
    monkeypatch.setattr(pivots, "KEY", 1)
    same(pivots.near_duplicates(table, pivots=8).collect(), expected)


def test_pivot_index_of_few(spark):
    none = spark.createDataFrame([], VECTORS)
    assert pivots.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(1, [0.5, 1.0], 3)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in pivots.near_duplicates(one).collect()] == [(1, 0, 1, True)]
    two = one.unionByName(spark.createDataFrame([(0, [1.0, 2.0], 3), (5, [-1.0, 2.0], 3)], one.schema))
    same(pivots.near_duplicates(two).collect(), [(1, 1, 0, False), (0, 1, 0, True), (5, 0, 5, True)])
    with pytest.raises(TypeError):
        pivots.near_duplicates(one.withColumn("vec_id", F.lit("a")))


def test_pivot_recall():
    """Pairs at the limit itself, the hardest ones: the share that the index brings together."""
    rng = np.random.default_rng(1)
    direct = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    all_, x = direct(rng.normal(size=(3000, 64))), direct(rng.normal(size=(2000, 64)))
    side = rng.normal(size=x.shape)
    side = direct(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side
    a, b = (pivots.nearest(v, all_[: pivots.PIVOTS], pivots.NEAREST) for v in (x, y))
    met = [len(set(p) & set(q)) >= pivots.SHARED for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.mean(met) >= 0.97


def test_forest():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n, m = rng.integers(1, 9, 2)
        hit = rng.random((n, m)) < 0.25
        up = list(range(n + m))
        for i, j in zip(*np.nonzero(hit), strict=True):
            a, b = up[i], up[n + j]
            up = [min(a, b) if u in (a, b) else u for u in up]
        assert np.r_[pivots.forest(hit)].tolist() == up


def test_posted_signatures_stay_out_of_the_driver(spark):
    """A signature is as many rows as it has keys, which its table's bytes don't tell."""
    rows = spark.range(500).selectExpr("id AS sid", "'64:1' AS `group`", "transform(sequence(0, 7), i -> cast(i * 30 + id % 17 AS int)) AS pivots")
    found = pivots.candidates(materialize(rows, "signatures"), 8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 500

"""Host-level quality rules in DataFrame functions only.

Each text gets counts and a verdict of its own; failures are summed by host, each host's failure rate is shrunk
towards a beta prior fitted to all hosts by moments, and the host's verdict is joined back to its documents.

Null or empty texts have no words and fail. Rows with a null host get no host verdict. Repeated rows each count
and each get a row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What separates words, and the symbol characters.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long.

    Repeated 3-word windows are found inside the row: window hashes (64 bits) sort beside their positions, equal
    neighbours mark their positions, and the marked positions' cover is summed. No row leaves its task.
    """
    t = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    t = t.withColumns({"_w": F.array_remove(F.split("_t", r"[ \t-\r]+"), ""), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))})
    chars = lambda out: F.length("_t") - F.length(F.translate("_t", out, ""))
    t = t.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - chars(SPACES)).cast("long").alias("word_chars"),
        chars(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))).alias("_h"),
    )
    marked = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    t = t.withColumn("_s", marked)
    same = lambda s, i: F.get("_s", i)["h"] == s["h"]
    t = t.withColumn("_p", F.sort_array(F.filter(F.transform("_s", lambda s, i: F.when(F.coalesce(same(s, i - 1), F.lit(False)) | F.coalesce(same(s, i + 1), F.lit(False)), s["p"])), lambda p: p.isNotNull())))
    cover = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_h", "_s", "_p")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def host_rates(counts: DataFrame, host: str, failed: str) -> DataFrame:
    """host, n_docs, n_failed, rate: the posterior mean under a beta prior with the hosts' mean and variance."""
    hosts = counts.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    got = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("i")).first()
    m = min(max(got["m"] or 0.0, 1e-3), 1 - 1e-3)
    spread = m * (1 - m)
    between = min(max((got["v"] or 0.0) - spread * (got["i"] or 0.0), spread * 1e-3), spread * 0.5)  # without the sampling variance
    strength = spread / between - 1
    return hosts.withColumn("rate", (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength))


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", max_rate: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc_id, host, the counts, base_failed, host_rate, host_failed, kept.

    A host fails if its shrunk rate of failing documents is over max_rate. The hosts' table joins back as an
    equi-join; Spark broadcasts it only if it measures small, else splits a hot host's rows.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    counts = document_counts(d, "text", ("doc_id", "host"))
    counts = materialize(counts.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "host-rules")
    rates = host_rates(counts, "host", "base_failed").select("host", F.col("rate").alias("host_rate"))
    out = counts.join(rates, "host", "left")
    out = out.withColumn("host_failed", F.coalesce(F.col("host_rate") > max_rate, F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))

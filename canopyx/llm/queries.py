"""The thin opN queries over a folder of tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, crosstok, fim, host_rules, langid, mixing, mpegts, packing, pii, pivots, simhash, substring, toxicity
from .common import fold


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return bpe.read_ranks(f.readlines())


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return mixing.score(docs, ~F.col("held_out"), keep=("held_out",))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _ranks("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), _ranks("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.store(_documents(spark, sf_dir)).drop("random_access")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, toxicity.train(docs, labels), keep=("doc_id", "held_out"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = langid.train(docs.where(~F.col("held_out")), langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(_documents(spark, sf_dir))
    length = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return out.select("doc_id", "n", "form", length("prefix"), length("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = crosstok.Pieces(f.read())
    return crosstok.score(_documents(spark, sf_dir), crosstok.ByteLevel(_ranks("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), pieces)


def op13_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_personal_data": op2_personal_data,
    "op3_host_rules": op3_host_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_transport_stream": op6_transport_stream,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_pivot_index": op13_pivot_index,
}
_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op3_host_rules": rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS_SQL} AS w FROM documents),
  win AS (SELECT doc_id, i, w[i:i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
  rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY 1),
  l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
  d AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM t JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM d),
  h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY 1),
  m AS (SELECT least(greatest(avg(k / n), 1e-3), 1 - 1e-3) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS i FROM h),
  p AS (SELECT m, m * (1 - m) / least(greatest(v - m * (1 - m) * i, m * (1 - m) * 1e-3), m * (1 - m) * 0.5) - 1 AS strength FROM m),
  g AS (SELECT source, (k + m * strength) / (n + strength) > 0.5 AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM f LEFT JOIN g USING (source)""",
    "op9_substring_dedup": rf"""WITH t AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
  low AS (SELECT k, min(doc_id) AS d FROM win GROUP BY 1),
  gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN low USING (k), range(13) r(j) WHERE d < doc_id) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM t LEFT JOIN gone USING (doc_id)""",
    "op11_fill_in_middle": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents),
  d AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_pivot_index": """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY 1) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)""",
}

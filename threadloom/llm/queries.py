"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import audit, decontaminate, jaccard, language, lines, neighbours, packing, ppm, quality, resample, token_counts, tokens, urls
from threadloom.llm.common import in_fold, table

Query = Callable[[SparkSession, str], DataFrame]

RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens, in pieces of at most the largest length, placed into bins."""
    return packing.pack(packing.token_lengths(table(spark, sf, "documents"), tokens.tokenizer_path()))


def op2_token_output(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as read back from written segments."""
    return tokens.documents_of(tokens.write_tokens(table(spark, sf, "documents"), path=tokens.tokenizer_path()))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without later occurrences of its line windows."""
    return lines.dedup_lines(table(spark, sf, "documents"), removed="n_removed").select("doc_id", "text", "n_removed")


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of a benchmark item in a document."""
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality, learnt outside the held-out fold."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_quality(docs, labels, ~in_fold("doc_id", 3))
    scores = quality.quality_scores(docs, model)
    return scores.select("doc_id", in_fold("doc_id", 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's verdict."""
    pages = table(spark, sf, "pages")
    return urls.judge_urls(pages, RULES, urls.fit_urls(pages, RULES))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's language, learnt outside the held-out fold."""
    docs = table(spark, sf, "documents")
    model = language.fit_languages(docs, ~in_fold("doc_id", 3))
    return language.predict_languages(docs, model).select("doc_id", in_fold("doc_id", 3).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's log probability, learnt outside the held-out fold."""
    scores = ppm.lm_scores(table(spark, sf, "documents"), ~in_fold("doc_id", 5))
    return scores.select("doc_id", in_fold("doc_id", 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return neighbours.nearest(table(spark, sf, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op10_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's class of near-duplicates and number of links."""
    return jaccard.near_duplicates(table(spark, sf, "documents"))


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each step of each order of five filters does to the documents of every source."""
    return audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's bytes and tokens."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's likeness to the benchmark and whether it is drawn."""
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_token_output, op3_line_dedup, op4_decontamination, op5_quality_classifier,
        op6_url_filter, op7_language_id, op8_lm_scoring, op9_nearest_neighbours, op10_ngram_jaccard,
        op11_filter_audit, op12_token_counts, op13_importance_resampling,
    )
} | {"pipeline": corpus_pipeline.run}

_LINE_SQL = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 1))) AS pos FROM d),
x AS (SELECT doc_id, pos, len(ls) AS n, ls[pos + 1 : pos + 3] AS win FROM w),
y AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM x
  WHERE len(list_filter(win, lambda l: trim(l) <> '')) > 0),
gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, n, unnest([pos, pos + 1, pos + 2]) AS p FROM y WHERE rn > 1) WHERE p < n),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN ps IS NULL THEN text
       ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(ps, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
  CAST(coalesce(len(ps), 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN g USING (doc_id)"""

_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT part, doc_id,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
k(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM k v, k w, k x, k y, k z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS gone
  FROM o, range(1, 6) r(step)),
x AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | gone) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & gone <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x"""

SQL: dict[str, str] = {"op3_line_dedup": _LINE_SQL, "op11_filter_audit": _AUDIT_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

"""Statistics of every document, and the documents that aren't prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vektora.llm.text_quality import common_sets, deciding, load_rules, not_prose, statistics
from vektora.session import spread

STATISTICS = ["n_words", "mean_word_length", "symbol_ratio", "ending_share", "common_share"]


def stats(spark: SparkSession, sf: str, only: list[str]) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    return statistics(d, "doc_id", "text", "lang", common_sets(spark.read.parquet(f"{sf}/common_words.parquet")), only)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(stats(spark, sf, deciding(load_rules()))).filter("kind IS NOT NULL").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(stats(spark, sf, [*STATISTICS, *deciding(load_rules())])).select("doc_id", *STATISTICS, "kind")


def p9_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that SQL can repeat."""
    return stats(spark, sf, STATISTICS[:4])


def p9_common(spark: SparkSession, sf: str) -> DataFrame:
    """The share of common words, by language where it is usable."""
    return stats(spark, sf, ["common_share"])


_GAP = r"[\s\p{Z}\p{Cf}]"
QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_counts": p9_counts, "p9_common": p9_common}
ORACLES = {
    "p9_counts": rf"""
WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_GAP}+'), lambda x: x <> '') AS tokens,
  list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: regexp_matches(x, '[^\s\p{{Z}}\p{{Cf}}]')) AS rows FROM documents),
n AS (SELECT *, list_sum(list_transform(tokens, lambda x: length(x))) AS chars, length(regexp_replace(text, '\P{{L}}+', '', 'g')) + length(regexp_replace(text, '\P{{Nd}}+', '', 'g')) AS plain FROM t)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_words,
  CASE WHEN text IS NULL THEN NULL WHEN len(tokens) > 0 THEN round(chars / len(tokens), 4) ELSE 0.0 END AS mean_word_length,
  CASE WHEN text IS NULL THEN NULL WHEN chars > 0 THEN round((chars - plain) / chars, 4) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN text IS NULL THEN NULL WHEN len(rows) > 0 THEN round(len(list_filter(rows, lambda x: regexp_matches(x, '[.!?…。！？:;]["''”’»)\]]*\s*$'))) / len(rows), 4) ELSE 0.0 END AS ending_share FROM n""",
    "p9_common": r"""
WITH cw AS (SELECT DISTINCT lang, word FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL),
unspaced AS (SELECT lang FROM cw GROUP BY 1 HAVING bool_and(regexp_matches(word, '^[぀-鿿]'))),
particles AS (SELECT coalesce(string_agg(word, '|' ORDER BY length(word) DESC, word), '[^\x{0}-\x{10FFFF}]') AS p FROM (SELECT DISTINCT word FROM cw WHERE lang IN (FROM unspaced))),
lists AS (SELECT lang, list(word) AS w FROM cw WHERE lang NOT IN (FROM unspaced) GROUP BY 1),
every AS (SELECT list(DISTINCT word) AS w FROM cw WHERE lang NOT IN (FROM unspaced)),
d AS (SELECT doc_id, text, lower(regexp_split_to_array(trim(lang, ' '), '[-_]')[1]) AS plain, regexp_extract_all(lower(text), '\p{L}+') AS names FROM documents),
n AS (SELECT d.*, length(array_to_string(names, '')) AS letters, length(regexp_replace(text, '[^぀-ヿ一-鿿]+', '', 'g')) AS kana, coalesce(l.w, every.w) AS w FROM d LEFT JOIN lists l ON l.lang = plain CROSS JOIN every)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL
  WHEN kana * 3 > letters THEN CASE WHEN letters > 0 THEN round(length(array_to_string(regexp_extract_all(text, p), '')) / letters, 4) ELSE 0.0 END
  WHEN len(names) > 0 THEN round(len(list_filter(names, lambda x: list_contains(w, x))) / len(names), 4) ELSE 0.0 END AS common_share FROM n, particles""".strip(),
}

"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import leakage, lines, mixing, pairs, pii, quality, scan_noise, subjects
from paperloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(table(spark, folder, "paragraph_panel"))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, folder, "paragraph_panel"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    panel = table(spark, folder, "paragraph_panel")
    chain = subjects.train(panel, table(spark, folder, "subject_labels"), table(spark, folder, "paragraph_theme_prevalence_by_group"))
    # Paragraphs that are no prose have no subject.
    marks = quality.not_prose(panel).select("paragraph_id", F.lit(True).alias("not_prose"))
    found = subjects.subjects_of(panel, chain).join(marks, "paragraph_id", "left")
    return found.withColumn("subjects", F.when(F.col("not_prose"), F.array().cast("array<string>")).otherwise(F.col("subjects"))).drop("not_prose")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("paragraph_id", F.explode("subjects").alias("theme"))


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_shares(_subjects(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.noise_outside_junk(table(spark, folder, "line_text"), table(spark, folder, "paragraph_panel"))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repaired(table(spark, folder, "line_text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "paragraph_panel"))


def p4_issues(spark: SparkSession, folder: str) -> DataFrame:
    return quality.issue_text_kinds(table(spark, folder, "paragraph_panel"), table(spark, folder, "corpus_issue_level_summary"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.pair_table(table(spark, folder, "paragraph_terms"), "paragraph_id", "node", "loaded_at")
    return found.associated().select("term_a", "term_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.pair_table(table(spark, folder, "paragraph_terms"), "paragraph_id", "node", "loaded_at").pairs()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.without_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_too_short(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.too_short(table(spark, folder, "eval_items"))


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder).where("short").select("source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder)


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.curriculum(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.items(table(spark, folder, "documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (p1_found, p1_clean, p2_found, p2_shares, p3_found, p3_paragraphs, p4_found, p4_issues, p5_found, p5_pairs, p6_found, p6_clean, p6_too_short, p7_found, p7_shares, p7_order, p8_found, p8_clean)
    }


_FORM = r"regexp_replace(lower({}), '[^\p{{L}}]+', '', 'g')"

_P1 = f"""
WITH once AS (
  SELECT paragraph_id, max(file_name) AS file_name, max(paragraph_text) AS paragraph_text
  FROM paragraph_panel WHERE paragraph_id IS NOT NULL GROUP BY 1
), parts AS (
  SELECT paragraph_id, file_name, string_split(paragraph_text, chr(10)) AS ls FROM once
), numbered AS (
  SELECT paragraph_id, file_name, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM parts
), forms AS (
  SELECT paragraph_id, file_name, line, line_no, {_FORM.format("line")} AS form FROM numbered
), sizes AS (
  SELECT file_name, count(*) AS n_all FROM once GROUP BY 1
), excessive AS (
  SELECT f.file_name, form FROM forms f JOIN sizes USING (file_name) WHERE length(form) >= 20
  GROUP BY 1, 2, n_all HAVING count(DISTINCT paragraph_id) >= 5 AND count(DISTINCT paragraph_id) >= 0.01 * n_all
), hit AS (
  SELECT DISTINCT paragraph_id, line_no FROM forms f JOIN excessive e
  ON f.file_name = e.file_name AND abs(length(f.form) - length(e.form)) <= 2 AND levenshtein(f.form, e.form) <= 2
)
"""

_P5 = r"""
WITH t AS (
  SELECT DISTINCT paragraph_id, trim(regexp_replace(lower(node), '[\s_-]+', ' ', 'g')) AS node FROM paragraph_terms
  WHERE paragraph_id IS NOT NULL AND trim(regexp_replace(lower(node), '[\s_-]+', ' ', 'g')) <> ''
), n AS (SELECT count(DISTINCT paragraph_id) AS n FROM t),
m AS (SELECT node, count(*) AS k FROM t GROUP BY 1),
ab AS (SELECT a.node AS term_a, b.node AS term_b, count(*) AS n_ab FROM t a JOIN t b ON a.paragraph_id = b.paragraph_id AND a.node < b.node GROUP BY 1, 2),
scored AS (
  SELECT term_a, term_b, n_ab, (n_ab / (ma.k::DOUBLE * mb.k)) * n::DOUBLE AS lift,
    n_ab * n >= 3 * ma.k * mb.k AS above, n
  FROM ab JOIN m ma ON ma.node = term_a JOIN m mb ON mb.node = term_b, n
)
"""

_SILENT = "­​‌‍⁠﻿''’‘ʼ´`"

_P6 = f"""
WITH words AS (
  SELECT 0 AS is_item, doc_id AS id, text AS t FROM documents UNION ALL SELECT 1, item_id, passage FROM eval_items
), cut AS (
  SELECT is_item, id, regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(t, '[-‐‑¬­][ \\t]*\\n\\s*', '', 'g'), '[{_SILENT}]', '', 'g'))), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM words WHERE t IS NOT NULL
), grams AS (
  SELECT is_item, id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM cut WHERE len(w) >= 12
)
SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM grams d JOIN grams e ON d.g = e.g AND d.is_item = 0 AND e.is_item = 1
"""

_SHORT = f"""
SELECT * FROM (SELECT item_id, max(coalesce(len(regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(passage, '[-‐‑¬­][ \\t]*\\n\\s*', '', 'g'), '[{_SILENT}]', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')), 0)) AS n_words
FROM eval_items WHERE item_id IS NOT NULL GROUP BY 1) WHERE n_words < 12
"""

_P7 = """
WITH t AS (SELECT lower(trim(source)) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1),
s AS (SELECT source, coalesce(sum(length(text)), 0) AS n FROM t LEFT JOIN (SELECT lower(trim(source)) AS source, text FROM documents) USING (source) GROUP BY 1)
SELECT source FROM t JOIN s USING (source) WHERE target_share * (SELECT sum(n) FROM s) > max_repeats * n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT paragraph_id, line_no::INTEGER AS line_no FROM hit",
        "p1_clean": _P1
        + """SELECT o.paragraph_id, CASE WHEN max(o.paragraph_text) IS NOT NULL THEN
             coalesce(string_agg(f.line, chr(10) ORDER BY f.line_no) FILTER (WHERE h.line_no IS NULL), '') END AS clean_text,
             count(h.line_no)::INTEGER AS n_removed
             FROM once o LEFT JOIN forms f USING (paragraph_id) LEFT JOIN hit h ON h.paragraph_id = f.paragraph_id AND h.line_no = f.line_no GROUP BY 1""",
        "p5_found": _P5 + "SELECT term_a, term_b FROM scored WHERE n_ab >= 5 AND n_ab >= 0.002 * n AND above",
        "p5_pairs": _P5 + "SELECT term_a, term_b, n_ab, lift FROM scored",
        "p6_found": _P6,
        "p6_too_short": _SHORT,
        "p7_found": _P7,
    }

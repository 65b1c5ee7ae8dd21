"""Queries over the whole tables, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from . import decontam, exact, packing, pii, quality, simhash, substring, tokencount, toxicity, wavelet
from .common import table


def op1_substring_dedup(spark, sf_dir):
    return substring.repeats(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


def op6_identifiers(spark, sf_dir):
    return pii.extracted(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_matrix(spark, sf_dir):
    return wavelet.sharded(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return tokencount.recounted(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, keeper AS duplicate_of
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> keeper""",
    "op7_decontamination": f"""
        WITH item AS (
            SELECT item_id, string_split(lower(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' ') AS w FROM benchmark),
        phrase AS (
            SELECT p, min(item_id) AS item_id FROM (
                SELECT item_id, unnest(CASE WHEN len(w) >= {decontam.N} THEN list_transform(range(1, len(w) - {decontam.N} + 2), lambda i: array_to_string(w[i:i + {decontam.N} - 1], ' '))
                    WHEN w[1] <> '' THEN [array_to_string(w, ' ')] END) AS p FROM item) GROUP BY p),
        len_ AS (SELECT DISTINCT len(string_split(p, ' ')) AS n FROM phrase),
        doc AS (
            SELECT DISTINCT doc_id, string_split(lower(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' ') AS w FROM documents WHERE text IS NOT NULL),
        gram AS (
            SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS start, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS p
            FROM doc, len_ WHERE len(w) >= n),
        hit AS (SELECT doc_id, start, start + n AS stop, item_id FROM gram JOIN phrase USING (p)),
        mark AS (
            SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
        run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM mark)
        SELECT DISTINCT doc_id, start, "end", item_id FROM (
            SELECT doc_id, min(start) AS start, max(stop) AS "end", min(item_id) AS item_id FROM run GROUP BY doc_id, g)""",
}

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_best_fit_packing, op4_toxicity, op5_simhash, op6_identifiers, op7_decontamination, op8_token_matrix, op9_token_counts, op10_quality)}

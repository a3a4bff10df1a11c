"""DuckDB SQL of the columns that SQL can express: the contracts' base columns, which the queries of ``queries.BASES`` select.

Scores, verdicts, fingerprints and draws can't be expressed in it; tests compare those with brute force.
"""

from __future__ import annotations

#: A word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"

DIVERGENCE_BASE = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
each AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM docs),
windows AS (
  SELECT row, i, n, word || chr(10) || lead(word, 1) OVER w || chr(10) || lead(word, 2) OVER w || chr(10) || lead(word, 3) OVER w || chr(10) || lead(word, 4) OVER w AS key
  FROM each WINDOW w AS (PARTITION BY row ORDER BY i)
),
twice AS (SELECT row, i, key IS NOT NULL AND count(*) OVER (PARTITION BY row, key) > 1 AS again FROM windows),
covered AS (SELECT row, max(again::int) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again FROM twice),
repeats AS (SELECT row, sum(again)::bigint AS n FROM covered GROUP BY row),
lines AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n, 0)::bigint AS n_repeat_words,
  len(words) < 10 OR 100 * coalesce(n, 0) > 20 * len(words) AS base_failed
FROM docs JOIN lines USING (row) LEFT JOIN repeats USING (row)
"""

PIECEWISE_EDITS = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, length(text) // 4 AS n FROM docs WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
)
SELECT doc_id, length(text)::bigint AS n_chars, sha256(left(text, length(text) - n) || left(following, n)) AS edited_sha256 FROM pairs
"""

MIXING_TARGETS = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint AS size FROM documents),
sizes AS (SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS weight, 1.5::double * sum(source_size) OVER () AS whole FROM sizes),
ordered AS (SELECT *, row_number() OVER (ORDER BY 2.0::double * source_size / weight, source NULLS LAST) AS k, sum(weight) OVER () AS heavy FROM weighed),
before AS (
  SELECT *, coalesce(sum(2.0::double * source_size) OVER w, 0) AS given, coalesce(sum(weight) OVER w, 0) AS gone FROM ordered
  WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
free AS (SELECT k, (whole - given) / (heavy - gone) AS each FROM before WHERE (whole - given) / (heavy - gone) * weight <= 2.0::double * source_size ORDER BY k LIMIT 1),
targets AS (SELECT b.source, b.source_size, CASE WHEN f.k IS NULL OR b.k < f.k THEN 2.0::double * b.source_size ELSE f.each * b.weight END AS target FROM before b LEFT JOIN free f ON true)
SELECT doc_id, size, source_size, target FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
"""

LICENSE_BASE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents
),
each AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM docs),
runs AS (SELECT row, i, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third FROM each WINDOW w AS (PARTITION BY row ORDER BY i)),
places AS (
  SELECT row, i, CASE WHEN word = 'mit' AND second = 'license' THEN 'mit' WHEN word = 'apache' AND second = 'license' THEN 'apache'
    WHEN word = 'general' AND second = 'public' AND third = 'license' THEN 'gpl' END AS label FROM runs
),
found AS (SELECT row, count(*)::bigint AS n_base, min(i)::bigint AS first_word, max(i)::bigint AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places WHERE label IS NOT NULL GROUP BY row)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM docs LEFT JOIN found USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"divergence_base": DIVERGENCE_BASE, "piecewise_edits": PIECEWISE_EDITS, "mixing_targets": MIXING_TARGETS, "license_base": LICENSE_BASE}

"""DuckDB SQL for the text operators whose results SQL can express.

The others are held against brute force, a library or an exact round trip in ``tests/llm``.
"""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op13_quality_rules": f"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines FROM d),
wins AS (
  SELECT rid, i, words[i:i+4] AS win FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(COALESCE(list_max([length(x) FOR x IN words]), 0) AS BIGINT) AS longest_word
  FROM w LEFT JOIN rep USING (rid)),
bits AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)::INT + 8 * (10 * n_symbols > n_words)::INT
    + 16 * (word_chars < 3 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT
    + 64 * (longest_word > 1000)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, longest_word, fail_bits
FROM bits""",
}

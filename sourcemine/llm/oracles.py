"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_quality_ledger"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), runs AS (
  SELECT r, i, list_slice(words, i, i + 7) AS run
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), again AS (
  SELECT r, run FROM runs GROUP BY r, run HAVING count(*) > 1
), repeated AS (
  SELECT r, count(DISTINCT place) AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS place FROM runs SEMI JOIN again USING (r, run)
  ) GROUP BY r
), lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    len(regexp_extract_all(text, '!!')) AS n_shouts
  FROM w LEFT JOIN line_counts USING (r) LEFT JOIN repeated ON repeated.r = w.r
), b AS (
  SELECT *,
    IF(n_words < 20, 1, 0) + IF(100 * n_repeat_words > 30 * n_words, 2, 0)
    + IF(word_chars < 2 * n_words OR word_chars > 15 * n_words, 4, 0)
    + IF(5 * n_symbols > n_words, 8, 0)
    + IF(2 * n_dup_lines > n_lines AND n_dup_lines >= 3, 16, 0)
    + IF(2 * n_upper > word_chars AND n_words >= 20, 32, 0)
    + IF(4 * n_shouts > n_words, 64, 0) AS bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept,
  CAST(bits AS BIGINT) AS fail_bits
FROM b
"""

ORACLES["op8_chat_prefix_targets"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM range(2) AS r(i)
), m AS (
  SELECT *,
    length('<turn><says></turn>') + 1
    + length(replace(replace(role, '\', '\\'), '<', '\<'))
    + length(replace(replace(text, '\', '\\'), '<', '\<')) AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

ORACLES["op10_norm_sorted_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = v.label AS alike, v.r, v.vec_id,
    CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.r <> v.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5
), n AS (
  SELECT p.a, p.anchor_id, p.r, p.vec_id AS positive_id, p.score AS positive_score,
    s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.alike
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""

ORACLES["op13_phrase_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, list_slice(words, i, i + size - 1) AS g
  FROM (
    SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size
  )
), f AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100
), c AS (
  SELECT lang, g, f AS a FROM f WHERE len(g) > 1
), cuts AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, totals.n,
    (CAST(1000 AS HUGEINT) * c.a * totals.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k)
  JOIN f AS y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))
  JOIN totals ON totals.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT o.lang, c.g
  FROM (
    SELECT lang, a, list_slice(g, i, i + size - 1) AS g
    FROM (SELECT *, unnest(range(1, len(g) - size + 2)) AS i
      FROM (SELECT *, unnest(range(2, len(g))) AS size FROM c))
  ) AS o JOIN c ON c.lang = o.lang AND c.g = o.g WHERE 100 * o.a >= 100 * c.a
), kept AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM best ANTI JOIN inside USING (lang, g)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""

"""DuckDB statements for the operators that SQL can express."""

from linemill.llm.licenses import TEMPLATES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in pair)) for pair in TEMPLATES.items())

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM parts WHERE line <> ''
), windows AS (
  SELECT doc_id, r, line, length(line) - length(replace(line, ' ', '')) + 1 AS words,
    line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY r) AS two FROM full_lines
), later AS (
  SELECT doc_id, r FROM (SELECT doc_id, r, row_number() OVER (PARTITION BY two ORDER BY doc_id, r) AS k FROM windows WHERE two IS NOT NULL) WHERE k > 1
), gone AS (
  SELECT doc_id, r FROM later
  UNION SELECT doc_id, r + 1 FROM later
  UNION SELECT doc_id, r FROM (SELECT doc_id, r, row_number() OVER (PARTITION BY line ORDER BY doc_id, r) AS k FROM windows WHERE words >= 50) WHERE k > 1
), marked AS (
  SELECT p.doc_id, p.i, p.line, f.r IS NOT NULL AS is_line, g.r IS NOT NULL AS is_gone
  FROM parts p LEFT JOIN full_lines f ON p.doc_id = f.doc_id AND p.i = f.i LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.r = g.r
)
SELECT doc_id, CAST(count(*) FILTER (is_line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (is_gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_chat_format": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), digest AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length('<|im_start|>') + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>')) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS formatted_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM digest""",
    "op5_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), hits AS (
  SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), item_lists AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words_hit USING (doc_id) LEFT JOIN item_lists USING (doc_id)""",
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 20""",
    "op6_licenses": rf"""
WITH templates AS (
  SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT license, {_WORDS.format('body')} AS w FROM (VALUES {_TEMPLATES}) v(license, body))
), stretches AS (
  SELECT doc_id, 'line' AS kind, 0 AS k, unnest(string_split(text, chr(10))) AS x FROM documents
  UNION ALL SELECT doc_id, 'paragraph', 1, trim(p, chr(10)) FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n+')) AS p FROM documents) WHERE contains(trim(p, chr(10)), chr(10))
  UNION ALL SELECT doc_id, 'text', 2, text FROM documents
), sized AS (
  SELECT doc_id, kind, k, {_WORDS.format('x')} AS w FROM stretches WHERE x <> ''
), sets AS (
  SELECT doc_id, kind, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM sized WHERE len(w) > 1
), scored AS (
  SELECT doc_id, kind, k, license, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM sets JOIN templates ON len(a) BETWEEN 0.8 / 1.2 * len(b) AND 1.2 / 0.8 * len(b)
), best AS (
  SELECT doc_id, license, max(dice) AS dice, arg_min(kind, (-dice, k)) AS kind FROM scored WHERE dice >= 0.8 GROUP BY ALL
), found AS (
  SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, first(license ORDER BY dice DESC, license) AS license,
    first(dice ORDER BY dice DESC, license) AS dice, first(kind ORDER BY dice DESC, license) AS kind FROM best GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, license, round(dice, 6) AS dice, kind, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN found USING (doc_id)""",
    "op9_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents
), blocks AS (
  -- 50 windows start in each block of 50 bytes and end in the next.
  SELECT doc_id, n, 50 * k AS pos, substr(h, 100 * k + 1, 200) AS part
  FROM (SELECT doc_id, hex(x) AS h, octet_length(x) AS n, unnest(range(0, octet_length(x) // 50 + 1)) AS k FROM d WHERE octet_length(x) >= 50)
), windows AS (
  SELECT doc_id, pos + j AS i, substr(part, 2 * j + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, 50)) AS j FROM blocks) WHERE pos + j + 50 <= n
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM windows) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later
), bytes AS (
  SELECT b.doc_id, b.p, b.byte, g.p IS NOT NULL AS is_gone
  FROM (SELECT doc_id, unnest(range(0, octet_length(x))) AS p, unnest(regexp_extract_all(hex(x), '..')) AS byte FROM d) b
  LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.p = g.p
), marked AS (
  SELECT *, is_gone AND NOT coalesce(lag(is_gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM bytes
), summed AS (
  SELECT doc_id, count(*) FILTER (is_gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(byte, '' ORDER BY p) FILTER (NOT is_gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN summed USING (doc_id)""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
}

"""DuckDB SQL of the training-data queries, named as the queries are."""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

op3_jaccard = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM word, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS r(i) WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM gram AS a JOIN gram AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM overlap JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = root
)
SELECT id AS doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN size ON doc_id = id GROUP BY id
"""

op4_decontaminate = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spot AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM doc, (SELECT DISTINCT m FROM pattern), unnest(range(1, len(w) - m + 2)) AS r(i)
), hit AS (
  SELECT doc_id, i, spot.m, item_id FROM spot JOIN pattern USING (m, s)
), word AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, hit.m)) AS r(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

op2_chat = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

op10_neighbours = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.id, b FROM reach JOIN link ON a = root
), least_of AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id
)
SELECT id AS vec_id, CAST((SELECT count(*) FROM link WHERE a = id) AS BIGINT) AS n_links, root AS component_id, id = root AS kept FROM least_of
"""

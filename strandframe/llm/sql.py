"""SQL of the text operators that SQL can express, for DuckDB."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

CONVERSATION_REPAIR = r"""
WITH RECURSIVE
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS h
  FROM conversations),
turns AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 200), sha256(concat_ws(':', role, text)), copy) AS n,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS occurrence FROM turns),
t AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
  CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 1 WHEN occurrence > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 3 ELSE 0 END AS fault FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
numbers AS (SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(n), 0) AS n
  FROM ids LEFT JOIN t ON ids.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ids.conv_id),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after a
ins(a, b, cost, audit, rep) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
kept(i, a, b) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)),
renamed(a, b, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
moves AS (
  SELECT conv_id, n, a, a AS b, 4 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS rep FROM t, (VALUES (0), (1), (2), (3)) s(a)
  UNION ALL SELECT conv_id, n, a, b, CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM t JOIN kept USING (i) WHERE fault NOT IN (1, 2)
  UNION ALL SELECT conv_id, n, a, b, CASE WHEN fault = 3 THEN 6 ELSE 3 END, 'R', [renamed.role || ':' || text] FROM t, renamed WHERE fault NOT IN (1, 2)),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': 0, 'audit': '', 'rep': CAST([] AS VARCHAR[])} AS best FROM ids
  UNION ALL
  SELECT p.conv_id, p.n + 1, m.b, min({'cost': p.best.cost + ins.cost + m.cost, 'audit': p.best.audit || ins.audit || m.audit, 'rep': p.best.rep || ins.rep || m.rep})
  FROM path p JOIN ins ON p.state = ins.a JOIN moves m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.n + 1 AND m.a = ins.b GROUP BY p.conv_id, p.n, m.b),
done AS (SELECT p.conv_id, min({'cost': p.best.cost + ins.cost, 'audit': p.best.audit || ins.audit, 'rep': p.best.rep || ins.rep}) AS best
  FROM path p JOIN numbers x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.n = x.n JOIN ins ON p.state = ins.a WHERE ins.b IN (0, 3) GROUP BY p.conv_id)
SELECT x.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
  sha256(array_to_string(best.rep, chr(10))) AS repaired_sha256
FROM numbers x JOIN done d ON x.conv_id IS NOT DISTINCT FROM d.conv_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM g),
p AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item FROM p JOIN g USING (k, gram)),
cover AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS word FROM hits) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN held USING (r)
"""

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS t FROM documents),
q AS (SELECT row_number() OVER () AS qr, item_id, list_distinct({_WORDS}) AS t FROM benchmark),
size AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
qt AS (SELECT qr, item_id, unnest(t) AS w FROM q),
tf AS (SELECT r, doc_id, n, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, size WHERE w IN (SELECT w FROM qt) GROUP BY w, nn),
s AS (SELECT qr, item_id, r, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM qt JOIN df USING (w) JOIN tf USING (w), size GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id ASC NULLS FIRST) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score FROM k WHERE k <= 10
"""

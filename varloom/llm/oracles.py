"""DuckDB SQL for the queries over conversations and over words."""

#: crc32 of a text's UTF-8 bytes: what each byte makes of the crc, then a fold over the bytes.
_CRC = """
bytes AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)))
)"""


def _crc(text: str) -> str:
    spelled = f"[CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex({text}), '..')]"
    return f"xor(list_reduce(list_prepend(4294967295, {spelled}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

OP11 = rf"""
WITH RECURSIVE {_CRC}, hits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_KEY)} % 20 AS hit FROM conversations, bytes
), kept AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE hit WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hits WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM kept
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM placed
), faulty AS (
  SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS short, role[1] AS i,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM ranked
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup,
    count(*) FILTER (short) AS short, count(*) FILTER (k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM faulty GROUP BY conv_id
), ways AS (
  -- the best ways to each place of the order: n(othing yet), after s, after u, after a
  SELECT conv_id, CAST(0 AS BIGINT) AS k, {{'c': 0, 'a': '', 't': ''}} AS n, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s,
    {{'c': 5, 'a': 'I', 't': 'user:'}} AS u, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM figures
  UNION ALL
  SELECT conv_id, k, n, s, least_u, list_sort(list_filter([least_a, {{'c': least_u.c + 5, 'a': least_u.a || 'I', 't': least_u.t || chr(10) || 'assistant:'}}], lambda x: x IS NOT NULL AND x.c IS NOT NULL))[1]
  FROM (
    SELECT *, list_sort(list_filter([step_u] || [CASE WHEN x.c IS NOT NULL THEN {{'c': x.c + 5, 'a': x.a || 'I', 't': CASE WHEN x.a = n.a AND x.c = n.c THEN '' ELSE x.t || chr(10) END || 'user:'}} END FOR x IN [n, s, step_a]], lambda x: x IS NOT NULL AND x.c IS NOT NULL))[1] AS least_u, step_a AS least_a
    FROM (
      SELECT w.conv_id, f.k,
        {{'c': w.n.c + 2, 'a': w.n.a || 'D', 't': w.n.t}} AS n,
        list_sort(list_filter([CASE WHEN w.s IS NOT NULL THEN {{'c': w.s.c + 2, 'a': w.s.a || 'D', 't': w.s.t}} END,
          CASE WHEN stays AND i = 's' THEN {{'c': w.n.c + more, 'a': w.n.a || 'K', 't': role || ':' || text}} END], lambda x: x IS NOT NULL AND x.c IS NOT NULL))[1] AS s,
        list_sort(list_filter([{{'c': w.u.c + 2, 'a': w.u.a || 'D', 't': w.u.t}}] || flatten([[
          CASE WHEN stays AND i = 'u' AND x.c IS NOT NULL THEN {{'c': x.c + more, 'a': x.a || 'K', 't': x.t || CASE WHEN x.t = '' AND replace(x.a, 'D', '') = '' THEN '' ELSE chr(10) END || role || ':' || text}} END,
          CASE WHEN stays AND x.c IS NOT NULL THEN {{'c': x.c + more + 1, 'a': x.a || 'R', 't': x.t || CASE WHEN x.t = '' AND replace(x.a, 'D', '') = '' THEN '' ELSE chr(10) END || 'user:' || text}} END]
          FOR x IN [w.n, w.s, w.a]]), lambda x: x IS NOT NULL AND x.c IS NOT NULL))[1] AS step_u,
        list_sort(list_filter([{{'c': w.a.c + 2, 'a': w.a.a || 'D', 't': w.a.t}},
          CASE WHEN stays AND i = 'a' THEN {{'c': w.u.c + more, 'a': w.u.a || 'K', 't': w.u.t || chr(10) || role || ':' || text}} END,
          CASE WHEN stays THEN {{'c': w.u.c + more + 1, 'a': w.u.a || 'R', 't': w.u.t || chr(10) || 'assistant:' || text}} END], lambda x: x IS NOT NULL AND x.c IS NOT NULL))[1] AS step_a
      FROM ways w, (SELECT *, NOT blank AND NOT dup AS stays, CASE WHEN short THEN 5 ELSE 0 END AS more FROM faulty) f
      WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1
    )
  )
), ends AS (
  SELECT w.conv_id, list_sort([w.n, w.a])[1] AS best FROM ways w JOIN figures f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.k
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate, coalesce(short, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12 = f"""
WITH RECURSIVE {_CRC}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents
), counted AS (
  SELECT d, r, count(*) AS n FROM runs GROUP BY d, r
), hashed AS (
  SELECT r, n, {_crc("d || ':' || r")} AS h FROM counted, bytes
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.part = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS top, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, CASE WHEN m >= 2 * w.n THEN top END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), way AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT y.word, f.form FROM way y JOIN formed f ON f.word = y.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, y.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN way y ON y.word = f.word JOIN formed e ON e.word = y.at WHERE e.form IS NULL
"""

OP13 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE)\]'))
    + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4 ELSE 17 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE)\]')) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

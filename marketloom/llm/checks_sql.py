"""DuckDB SQL of the operators that SQL can express."""
from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every item is compared with every place of every document by its words.
DECONTAMINATION = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT row_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM win))),
found AS (SELECT row_id, k, n, item_id FROM place JOIN win USING (n, phrase)),
hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY row_id),
its AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (row_id) LEFT JOIN its USING (row_id)
"""

#: The crc32 of a text of ASCII, bit by bit: a step is a byte to take in, or -1 for one of eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384::BIGINT * (acc & 1)) END), 4294967295::BIGINT)"""


def _plus(state: str, cost: str, edit: str) -> str:
    """An edit prefix, written as its cost in ten digits and its initials, with one more edit."""
    return f"lpad((left({state}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{edit}'"


#: Plain dynamic programming: one row per conversation and message, the cheapest edit prefix and the messages it
#: leaves for each state (none, s, u, a).  Prefixes are strings that begin with their cost, so that least() picks.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(x="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM base WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS i, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM faulty) GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS k, lpad('', 10, '0') AS e0, NULL::VARCHAR AS es, NULL::VARCHAR AS eu, NULL::VARCHAR AS ea FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, {_plus('e0', '2', 'D')},
    least({_plus('es', '2', 'D')}, CASE WHEN live AND i = 's' THEN {_plus('e0', 'stays', 'K')} END),
    least({_plus('iu', '2', 'D')}, CASE WHEN live AND i = 'u' THEN least({_plus('e0', 'stays', 'K')}, {_plus('es', 'stays', 'K')}, {_plus('ia', 'stays', 'K')}) END,
      CASE WHEN live THEN least({_plus('e0', 'stays + 1', 'R')}, {_plus('es', 'stays + 1', 'R')}, {_plus('ia', 'stays + 1', 'R')}) END),
    least({_plus('ia', '2', 'D')}, CASE WHEN live AND i = 'a' THEN {_plus('iu', 'stays', 'K')} END, CASE WHEN live THEN {_plus('iu', 'stays + 1', 'R')} END)
  FROM (
    SELECT dp.conv_id, f.k, f.i, f.fault NOT IN ('blank', 'duplicate') AS live, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS stays, e0, es,
      least(eu, {_plus('e0', '5', 'I')}, {_plus('es', '5', 'I')}, {_plus('ea', '5', 'I')}) AS iu, least(ea, {_plus('eu', '5', 'I')}) AS ia
    FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.k = dp.k + 1)),
best AS (
  SELECT dp.conv_id, least(e0, ea, {_plus('eu', '5', 'I')}) AS e FROM dp LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.k = coalesce(c.n, 0)),
edits AS (SELECT conv_id, substr(e, 11) AS audit, unnest(range(1, len(e) - 9)) AS p FROM best),
edited AS (
  SELECT conv_id, p, audit[p] AS edit, count(*) FILTER (audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS k FROM edits),
left_over AS (
  SELECT e.conv_id, e.p, e.edit, f.role, CASE e.edit WHEN 'I' THEN '' ELSE f.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) - coalesce(max(CASE WHEN e.edit = 'K' AND f.i = 's' THEN 1 END) OVER (PARTITION BY e.conv_id), 0) AS nth
  FROM edited e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k AND e.edit <> 'I' WHERE e.edit <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired FROM left_over GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, left(e, 10)::BIGINT AS cost, substr(e, 11) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""

#: Scores of all documents and items that share a term.
RANKED_SEARCH = rf"""
WITH doc AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT row_id, doc_id, len(w)::BIGINT AS n FROM doc WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM size),
tf AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(w) AS term FROM doc) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
score AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (row_id), total GROUP BY item_id, row_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

# CRC-32 of the list `bytes`, bit by bit; the polynomial is a fixed value.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_CHARACTER = r"[^\x20\x09-\x0D]"


def _insert(rest: str, role: str) -> str:
    return f"{{'c': {rest}.c + 3, 'a': 'I' || {rest}.a, 't': chr(10) || '{role}:' || {rest}.t}}"


def _least(stays: str, role: str, goes: str, kept: dict[str, str]) -> str:
    """The cheapest edit that uses up a row: it goes, it stays (in roles of kept), or its role becomes another."""
    free, cut = "fault NOT IN ('blank', 'duplicate')", "CASE fault WHEN 'truncated' THEN 3 ELSE 0 END"
    ways = [f"{{'c': {stays}.c + 4, 'a': 'D' || {stays}.a, 't': {stays}.t}}"]
    ways += [f"CASE WHEN {free} AND i = '{i}' THEN {{'c': {s}.c + {cut}, 'a': 'K' || {s}.a, 't': chr(10) || role || ':' || text || {s}.t}} END" for i, s in kept.items()]
    ways.append(f"CASE WHEN {free} THEN {{'c': {goes}.c + 3 + {cut}, 'a': 'R' || {goes}.a, 't': chr(10) || '{role}:' || text || {goes}.t}} END")
    return f"least({', '.join(ways)})"


ORACLES: dict[str, str] = {
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
             / nullif(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0), 0) AS level
            , row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth
      FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight,
             least(cap::DOUBLE, coalesce(arg_min(level, nth) FILTER (WHERE level <= ratio) OVER (), 0) * weight) AS target FROM l),
q AS (SELECT d.*, coalesce(sum(size) OVER p, 0) AS before, row_number() OVER (PARTITION BY source ORDER BY mark, size) AS place
      FROM d WINDOW p AS (PARTITION BY source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT q.source, place, size, turn, ((turn * source_size + before + size)::DOUBLE / weight) AS finish
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) AS x(turn) WHERE size > 0),
a AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS FIRST, place, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o),
c AS (SELECT source, place, count(*) AS copies FROM a WHERE ahead * 2 + size <= 2 * (SELECT sum(size) FROM d) GROUP BY source, place)
SELECT q.doc_id, q.size, t.source_size, t.target, (CASE WHEN q.size = 0 THEN 0 ELSE coalesce(copies, 0) * q.size END)::BIGINT AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source
LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.place = c.place""",
    "op11_conversations": rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM keyed),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM kinds WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS pos,
  count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS i,
  CASE WHEN NOT regexp_matches(text, '{_CHARACTER}') THEN 'blank'
       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 THEN 'duplicate'
       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM d),
-- cost, audit and text of what is left, by what came before: nothing, a system row, a user's, an assistant's
dp AS (SELECT conv_id, n + 1 AS pos, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1,
         {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}} AS s2, {{'c': 0, 'a': '', 't': ''}} AS s3 FROM o WHERE pos = 1
  UNION ALL
  SELECT conv_id, pos, least(b0, {_insert("s2", "user")}) AS s0, least(b1, {_insert("s2", "user")}) AS s1, s2, least(b3, {_insert("b2", "user")}) AS s3
  FROM (SELECT *, least(b2, {_insert("b3", "assistant")}) AS s2 FROM (SELECT o.conv_id, o.pos,
    {_least("s0", "user", "s2", {"s": "s1", "u": "s2"})} AS b0, {_least("s1", "user", "s2", {"u": "s2"})} AS b1,
    {_least("s2", "assistant", "s3", {"a": "s3"})} AS b2, {_least("s3", "user", "s2", {"u": "s2"})} AS b3
    FROM dp JOIN o ON o.conv_id IS NOT DISTINCT FROM dp.conv_id AND o.pos = dp.pos - 1))),
pairs AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
  sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.pos = 1""",
    "op12_url_filter": r"""
WITH rules(rule_host, rule_path, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT n, page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  coalesce(arg_max(says, length(rule_host || rule_path)), 'allow') AS verdict
FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY n, page_id""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND score BETWEEN ceil(positive_score * 80 / 100.0) AND positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}

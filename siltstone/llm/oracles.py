"""DuckDB SQL for those of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS host FROM documents),
s AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS words FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM s)),
again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, words) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
base AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM s LEFT JOIN covered USING (rid)),
l AS (SELECT rid, host, trim(line, ' ') AS line FROM (SELECT rid, host, unnest(string_split(regexp_replace(lower(t), '[0-9]+', '0', 'g'), chr(10))) AS line FROM d) WHERE trim(line, ' ') <> ''),
hosts AS (SELECT host, greatest(30, count(*) * CAST(0.001 AS DOUBLE)) AS bound FROM d GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT rid) AS n FROM l GROUP BY host, line) JOIN hosts USING (host) WHERE n > bound),
chars AS (SELECT rid, sum(length(l.line)) AS line_chars, sum(CASE WHEN o.line IS NOT NULL THEN length(l.line) ELSE 0 END) AS removed_chars FROM l LEFT JOIN often o ON o.host = l.host AND o.line = l.line GROUP BY rid),
judged AS (SELECT base.* EXCLUDE (rid), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars FROM base LEFT JOIN chars USING (rid))
SELECT *, NOT base_failed AND NOT removed_chars > CAST(0.6 AS DOUBLE) * line_chars AS kept FROM judged
"""

_CHATS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_OVERLAPS = r"""
WITH i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT row_number() OVER () AS iid, item_id, w, len(w) AS n, least(13, len(w)) AS width FROM i WHERE len(w) > 0),
ti AS (SELECT iid, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM items),
docs AS (SELECT row_number() OVER () AS did, doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
td AS (SELECT did, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM docs),
m AS (SELECT did, iid, td.pos - ti.pos AS shift, list(ti.pos) AS ps FROM td JOIN ti USING (tok) GROUP BY ALL),
r AS (SELECT doc_id, item_id, len(ps) AS matched, n, list_max(list_transform(range(1, n - width + 2), lambda s: len(list_filter(ps, lambda p: p >= s AND p < s + width)))) / CAST(width AS DOUBLE) AS overlap
 FROM m JOIN items USING (iid) JOIN docs USING (did) WHERE len(ps) >= CAST(0.8 AS DOUBLE) * width)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(n) AS BIGINT) AS item_tokens, max(overlap) AS overlap FROM r WHERE overlap >= CAST(0.8 AS DOUBLE) GROUP BY doc_id, item_id
"""

ORACLES = {"op5_quality_rules": _QUALITY, "op7_chat_format": _CHATS, "op9_decontamination": _OVERLAPS}

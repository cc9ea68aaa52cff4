"""DuckDB text of chat formatting: lines, runs of equal depth, passages compared as texts, replies followed to their start."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: str) -> str:
    return f"trim(regexp_replace(translate({text}, '{_UPPER}', '{_LOWER}'), '[\\x20\\t-\\r]+', ' ', 'g'))"


def _pieces(whole: str, lines: str) -> str:
    """The different passages of a run: the whole, its paragraphs, its lines; none without words."""
    return f"list_distinct(list_filter(list_transform(list_concat([{whole}], string_split_regex({whole}, '\\n[ \\t]*\\n'), {lines}), lambda x: {_normal('x')}), lambda x: x <> ''))"


SQL = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT rid, i, ls[i] AS line, regexp_extract(ls[i], '^[ \\t]*(?:>[ \\t]*)+') AS mark FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM m)),
d AS (SELECT rid, i, length(regexp_replace(mark, '[^>]', '', 'g')) AS depth, substr(line, length(mark) + 1) AS line FROM l),
n AS (SELECT *, lead(depth) OVER w AS next, i - row_number() OVER (PARTITION BY rid, depth ORDER BY i) AS run FROM d WINDOW w AS (PARTITION BY rid ORDER BY i)),
own AS (SELECT rid, list(line ORDER BY i) AS ls, trim(string_agg(line, chr(10) ORDER BY i), chr(10)) AS body FROM n
        WHERE depth = 0 AND NOT (coalesce(next, 0) > 0 AND regexp_matches(rtrim(line, ' ' || chr(9)), '(?i)\\b(?:wrote|writes|said|schrieb|a écrit|escribió)[^\\n]{{0,40}}:$')) GROUP BY rid),
q AS (SELECT rid, depth AS level, string_agg(line, chr(10) ORDER BY i) AS whole, list(line ORDER BY i) AS ls FROM n WHERE depth > 0 GROUP BY rid, depth, run),
qp AS (SELECT rid, level, {_pieces("whole", "ls")} AS ps FROM q),
msg AS (SELECT m.rid, m.conv_id, m.turn, m.role, coalesce(own.body, '') AS body, coalesce(own.ls, []) AS ls, coalesce((SELECT sum(len(ps)) FROM qp WHERE qp.rid = m.rid), 0)::BIGINT AS n_quotes FROM m LEFT JOIN own ON own.rid = m.rid),
wrote AS (SELECT DISTINCT conv_id, turn, unnest({_pieces("body", "ls")}) AS p FROM msg),
asks AS (SELECT DISTINCT conv_id, turn, level, unnest(ps) AS p FROM qp JOIN m ON m.rid = qp.rid),
hit AS (SELECT a.conv_id, a.turn, a.level, a.p, max(w.turn) AS source FROM asks a JOIN wrote w ON w.conv_id = a.conv_id AND w.p = a.p AND w.turn < a.turn GROUP BY ALL),
links AS (SELECT conv_id, turn, arg_min(source, (level, -source)) AS reply_to, count(*) AS n_linked FROM hit GROUP BY conv_id, turn),
chain AS (SELECT conv_id, turn, reply_to AS root FROM links UNION ALL SELECT c.conv_id, c.turn, x.reply_to FROM chain c JOIN links x ON x.conv_id = c.conv_id AND x.turn = c.root),
roots AS (SELECT conv_id, turn, min(root) AS root FROM chain GROUP BY conv_id, turn),
f AS (SELECT g.conv_id, g.turn, g.role, g.body AS text, links.reply_to, coalesce(roots.root, g.turn) AS thread, g.n_quotes, coalesce(links.n_linked, 0) AS n_linked
      FROM msg g LEFT JOIN links ON links.conv_id = g.conv_id AND links.turn = g.turn LEFT JOIN roots ON roots.conv_id = g.conv_id AND roots.turn = g.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position, turn, role, text, reply_to, thread, n_quotes, n_linked FROM f
"""

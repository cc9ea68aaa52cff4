"""DuckDB text of the secret scan: matches with their places from what a pattern takes out and leaves, parts joined by intervals."""

from __future__ import annotations

from pipelens.llm.secrets import KINDS, REACH


def _cased(word: str) -> str:
    """A word in either case, ASCII only: a pattern's own flag would take other letters for some."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_SET = r"""["'']?\x20*[:=]\x20*["'']?"""
_ANY = lambda *words: "(?:" + "|".join(map(_cased, words)) + ")"
ASSIGN = "(?:" + "|".join((*map(_cased, ("password", "passwd", "secret", "token")), _cased("api") + "_?" + _cased("key"))) + ")" + _SET + "([A-Za-z0-9+/_.=-]+)"
USER = "(?:" + _cased("user") + "(?:" + _cased("name") + ")?|" + "|".join(map(_cased, ("login", "account"))) + "|" + _cased("client") + "_?" + _cased("id") + ")" + _SET + "([A-Za-z0-9_.@-]{3,})"
ENDPOINT = (
    "(?:" + "|".join((_cased("http") + "[sS]?", "[sS]3", _cased("ftp"), _cased("postgres") + "(?:" + _cased("ql") + ")?", *map(_cased, ("mysql", "mongodb", "redis", "amqp")))) + r""")://[^\x20\t-\r"''<>|]{3,}"""
    + "|" + _ANY("host", "endpoint", "server") + _SET + "[A-Za-z0-9.-]{3,}"
)


def _found(name: str, kind: int, pattern: str, keep: str = "true", start: str = "pos") -> str:
    """A table (rid, kind, s, e) of a pattern's matches m that ``keep`` holds for."""
    return f"""{name}_l AS (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d),
{name}_m AS (SELECT rid, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS pos FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_l)),
{name} AS (SELECT rid, {kind} AS kind, ({start})::BIGINT AS s, (pos + length(m))::BIGINT AS e FROM {name}_m WHERE {keep})"""


_KEEP_KEY = """length(rtrim(m, '=')) >= 16 AND length(m) - length(rtrim(m, '=')) <= 2 AND NOT contains(rtrim(m, '='), '=') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"""
_NAMES = ", ".join(f"'{k}'" for k in KINDS)
_TEXT = f"string_agg(list_extract([{_NAMES}], (kind + 1)::INT) || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"


def _near(x: str, y: str) -> str:
    return f"{x}.rid = {y}.rid AND {x}.para = {y}.para AND greatest({x}.s - {y}.e, {y}.s - {x}.e) <= {REACH}"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_found("a0", 0, ASSIGN, f"length(regexp_extract(m, '{ASSIGN}', 1)) >= 6")},
{_found("a1", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")},
{_found("a2", 2, "[0-9a-f]{24,}")},
{_found("a3", 3, "[A-Za-z0-9+/_=-]{16,}", _KEEP_KEY)},
{_found("a4", 4, USER, start=f"pos + length(m) - length(regexp_extract(m, '{USER}', 1))")},
{_found("a5", 5, ENDPOINT)},
{_found("br", 9, r"\\n[ \\t]*\\n".replace(chr(92) * 2, chr(92)))},
base AS (FROM a0 UNION ALL FROM a1 UNION ALL FROM a2),
weak AS (SELECT * FROM a3 WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = a3.rid AND base.s <= a3.s AND a3.e <= base.e) UNION ALL FROM a4 UNION ALL FROM a5),
p AS (SELECT x.*, (SELECT count(*) FROM br WHERE br.rid = x.rid AND br.s < x.s) AS para FROM (SELECT DISTINCT * FROM (FROM base UNION ALL FROM weak)) x),
users AS (SELECT u.*, EXISTS (SELECT 1 FROM p y WHERE y.kind = 5 AND {_near("u", "y")}) AS placed, EXISTS (SELECT 1 FROM p y WHERE y.kind IN (0, 2, 3) AND {_near("u", "y")}) AS trusted FROM p u WHERE u.kind = 4),
linked AS (
  SELECT rid, kind, s, e FROM p k WHERE k.kind = 3 AND (EXISTS (SELECT 1 FROM p y WHERE y.kind = 1 AND {_near("k", "y")}) OR EXISTS (SELECT 1 FROM users y WHERE y.placed AND {_near("k", "y")}))
  UNION ALL SELECT rid, kind, s, e FROM users WHERE placed AND trusted
  UNION ALL SELECT rid, kind, s, e FROM p n WHERE n.kind = 5 AND EXISTS (SELECT 1 FROM users y WHERE y.trusted AND {_near("n", "y")})),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_TEXT} AS spans FROM base GROUP BY rid),
w AS (SELECT rid, {_TEXT} AS spans FROM (SELECT DISTINCT * FROM (FROM base UNION ALL FROM linked)) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(w.spans, '') AS spans
FROM d LEFT JOIN b ON b.rid = d.rid LEFT JOIN w ON w.rid = d.rid
"""

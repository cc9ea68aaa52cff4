"""DuckDB text of SimHash components: XXH64 in 128-bit arithmetic, bits by majority, links over all pairs of fingerprints."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WHOLE = 1 << 64


def _n(x: int) -> str:
    return f"{x % _WHOLE}::UHUGEINT"


def _cut(x: str) -> str:
    return f"(({x}) % {_WHOLE}::UHUGEINT)"


def _times(x: str, p: int) -> str:
    return _cut(f"({x}) * {_n(p)}")


def _turn(x: str, bits: int) -> str:
    """Rotated to the left."""
    return f"({_cut(f'({x}) * {_n(1 << bits)}')} + ({x}) // {_n(1 << (64 - bits))})"


def _read(at: str, size: int) -> str:
    """A little-endian number of ``size`` bytes from byte ``at`` of the hex text x."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * b + 1}, 2)" for b in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _lane(first: int, byte: int) -> str:
    """One of four sums over the stripes of 32 bytes."""
    step = _times(_turn(_cut(f"acc + {_times('k', P2)}"), 31), P1)
    return f"list_reduce(list_concat([{_n(first)}], list_transform(range(0, n // 32), lambda i: {_read(f'32 * i + {byte}', 8)})), lambda acc, k: {step})"


def hashes(source: str, seed: int) -> str:
    """Tables whose last, ``hashed``, has (g, h): the XXH64 of every different text g of ``source``."""
    mixed = lambda h, v: _cut(f"{_times(f'xor({h}, {_times(_turn(_times(v, P2), 31), P1)})', P1)} + {_n(P4)}")
    eight = _cut(f"{_times(_turn('xor(acc, ' + _times(_turn(_times('k', P2), 31), P1) + ')', 27), P1)} + {_n(P4)}")
    four = _cut(f"{_times(_turn('xor(h, ' + _times(_read('n // 8 * 8', 4), P1) + ')', 23), P2)} + {_n(P3)}")
    one = _times(_turn(f"xor(acc, {_times('k', P5)})", 11), P1)
    return f"""x0 AS (SELECT g, hex(encode(g)) AS x, strlen(g) AS n FROM (SELECT DISTINCT g FROM {source})),
x1 AS (SELECT *, {_lane(seed + P1 + P2, 0)} AS v1, {_lane(seed + P2, 8)} AS v2, {_lane(seed, 16)} AS v3, {_lane(seed - P1, 24)} AS v4 FROM x0),
x2 AS (SELECT *, {_cut(f"{_turn('v1', 1)} + {_turn('v2', 7)} + {_turn('v3', 12)} + {_turn('v4', 18)}")} AS h FROM x1),
x3 AS (SELECT * REPLACE ({mixed('h', 'v1')} AS h) FROM x2), x4 AS (SELECT * REPLACE ({mixed('h', 'v2')} AS h) FROM x3),
x5 AS (SELECT * REPLACE ({mixed('h', 'v3')} AS h) FROM x4), x6 AS (SELECT * REPLACE ({mixed('h', 'v4')} AS h) FROM x5),
x7 AS (SELECT g, x, n, {_cut(f"CASE WHEN n >= 32 THEN h ELSE {_n(seed + P5)} END + n::UHUGEINT")} AS h FROM x6),
x8 AS (SELECT g, x, n, list_reduce(list_concat([h], list_transform(range(n // 32 * 4, n // 8), lambda i: {_read('8 * i', 8)})), lambda acc, k: {eight}) AS h FROM x7),
x9 AS (SELECT g, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM x8),
x10 AS (SELECT g, list_reduce(list_concat([h], list_transform(range(n // 4 * 4, n), lambda i: {_read('i', 1)})), lambda acc, k: {one}) AS h FROM x9),
x11 AS (SELECT g, {_times(f"xor(h, h // {_n(1 << 33)})", P2)} AS h FROM x10), x12 AS (SELECT g, {_times(f"xor(h, h // {_n(1 << 29)})", P3)} AS h FROM x11),
hashed AS (SELECT g, xor(h, h // {_n(1 << 32)})::UBIGINT AS h FROM x12)"""


def sql(shingle: int = 3, bits: int = 3, seed: int = 42) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) END) AS g FROM d),
{hashes("s", seed)},
pow2 AS (SELECT [{", ".join(f"{1 << j}::UBIGINT" for j in range(64))}] AS bits),
c AS (SELECT rid, j, sum((h // list_extract(bits, j + 1)) % 2) AS ones, count(*) AS n FROM (SELECT rid, h, bits, unnest(range(0, 64)) AS j FROM s JOIN hashed USING (g), pow2) GROUP BY rid, j),
f AS (SELECT d.rid, d.doc_id, coalesce((SELECT bit_or(CASE WHEN 2 * ones > n THEN list_extract(bits, j + 1) ELSE 0::UBIGINT END) FROM c, pow2 WHERE c.rid = d.rid), 0)::UBIGINT AS fp FROM d),
u AS (SELECT DISTINCT fp FROM f),
e AS (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= {bits}),
r(a, b) AS (SELECT fp, fp FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT r.a AS fp, min(f.doc_id) AS component_id FROM r JOIN f ON f.fp = r.b GROUP BY r.a)
SELECT doc_id, lower(lpad(to_hex(f.fp), 16, '0')) AS fingerprint, component_id FROM f JOIN k ON k.fp = f.fp
"""

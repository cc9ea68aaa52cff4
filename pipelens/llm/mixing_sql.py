"""DuckDB text of the mix: hash order, passes over what does not fit, sizes, and the nearest document, as chained steps."""

from __future__ import annotations

from pipelens.llm.mixing import PASSES

_FITS = """
f{n} AS (SELECT *, free AND extra = 0 AND size <= {most} AS fit FROM {of}),
r{n} AS (SELECT *, CASE WHEN fit THEN sum(CASE WHEN fit THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY ends ROWS UNBOUNDED PRECEDING) END AS run FROM f{n}),
g{n} AS (SELECT * EXCLUDE (fit, run, gap, extra), extra + coalesce(fit AND run <= gap, false)::BIGINT AS extra,
                gap - coalesce(max(CASE WHEN run <= gap THEN run END) OVER (PARTITION BY source), 0) AS gap FROM r{n}),"""


def sql() -> str:
    passes = "".join(_FITS.format(n=n, most="gap", of=f"g{n - 1}") for n in range(1, PASSES + 1))
    last = _FITS.format(n=PASSES + 1, most="smallest", of="by_size")
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, 3 * source_size / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS all_weight,
             coalesce(sum(3 * source_size) OVER b, 0) AS capped_before, coalesce(sum(weight) OVER b, 0) AS weight_before
      FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped_before) / (all_weight - weight_before) AS level FROM o),
f AS (SELECT level AS final FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, weight, least(3 * source_size::DOUBLE, coalesce((SELECT final FROM f) * weight, 3 * source_size::DOUBLE)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM t),
e AS (SELECT d.*, p.source_size, p.weight, p.target, p.whole, p.target - p.whole * p.source_size AS rest, p.whole < 3 AND size > 0 AS free,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, (free AND ends <= rest)::BIGINT AS extra FROM e),
g0 AS (SELECT *, rest - coalesce(max(CASE WHEN extra = 1 THEN ends END) OVER (PARTITION BY source), 0) AS gap FROM x),{passes}
z AS (SELECT *, free AND extra = 0 AS left_over, sum(CASE WHEN free AND extra = 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY size) AS run FROM g{PASSES}),
by_size AS (SELECT * EXCLUDE (left_over, run, gap, extra), extra + (left_over AND run <= gap)::BIGINT AS extra,
                   gap - coalesce(max(CASE WHEN left_over AND run <= gap THEN run END) OVER (PARTITION BY source), 0) AS gap,
                   coalesce(min(CASE WHEN left_over AND run > gap THEN size END) OVER (PARTITION BY source), -1) AS smallest FROM z),{last}
v AS (SELECT *, free AND extra = 0 AND abs(size - gap) < gap AS near FROM g{PASSES + 1}),
n AS (SELECT * EXCLUDE (extra, near), extra + CASE WHEN near AND row_number() OVER (PARTITION BY source, near ORDER BY abs(size - gap), ends) = 1 THEN 1 ELSE 0 END AS extra FROM v),
c AS (SELECT *, whole + extra AS copies, sum(size * extra) OVER (PARTITION BY source ORDER BY k, doc_id, size, ends ROWS UNBOUNDED PRECEDING) AS run,
             CASE weight WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0 ELSE 0.5 END AS a, CASE weight WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0 ELSE 1.5 END AS b FROM n),
y AS (SELECT *, list_transform(list_transform(range(0, copies::BIGINT), lambda j: least(1.0::DOUBLE, greatest(0.0::DOUBLE, (j * source_size + CASE WHEN j = whole AND extra > 0 THEN run ELSE ends END - size::DOUBLE / 2) / target))),
             lambda q: CASE WHEN b = a THEN q ELSE (sqrt(a * a + 2 * (b - a) * (q * (a + b) / 2)) - a) / (b - a) END) AS positions FROM c),
h AS (SELECT coalesce(sum(target::DECIMAL(38, 6)) FILTER (weight = 1), 0)::DOUBLE AS t1, coalesce(sum(target::DECIMAL(38, 6)) FILTER (weight = 2), 0)::DOUBLE AS t2, coalesce(sum(target::DECIMAL(38, 6)) FILTER (weight = 3), 0)::DOUBLE AS t3 FROM t),
u AS (SELECT *, positions[1] AS p FROM y)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies, p AS first_position, positions,
  (t1 * ((1.5::DOUBLE * p + (-1.0::DOUBLE) * p * p / 2) / 1.0::DOUBLE) + t2 * ((1.0::DOUBLE * p + 0.0::DOUBLE * p * p / 2) / 1.0::DOUBLE) + t3 * ((0.5::DOUBLE * p + 1.0::DOUBLE * p * p / 2) / 1.0::DOUBLE)) / (t1 + t2 + t3) AS progress
FROM u, h
"""

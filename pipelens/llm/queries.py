"""One query for each operator of this folder, with DuckDB text where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm import ann, caps, chat, decontam, divergence, fim, mixing, ppm, secrets, simhash, tokenbin, toxicity, urlfilter
from pipelens.llm.chat_sql import SQL as CHAT_SQL
from pipelens.llm.common import crc_mod
from pipelens.llm.mixing_sql import sql as mixing_sql
from pipelens.llm.secrets_sql import SQL as SECRETS_SQL
from pipelens.llm.simhash_sql import sql as simhash_sql

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("file")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(_read(spark, sf_dir, "conversations"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assign(_read(spark, sf_dir, "documents"), refill=True)
    placed = rows.select("doc_id", "size", "source_size", "target", "taken", "copies", F.col("position").alias("first_position"), "positions", "progress")
    return placed.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), bits=3, shingle=3)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"), fim.code_points)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    again = digest(fim.restored(F.col("output"), F.col("form")))
    return cut.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), again.alias("restored_sha256"))


def op13_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(_read(spark, sf_dir, "embeddings"), similarity=0.93).drop("label")


_ALL = (op1_nearest, op2_toxicity, op3_token_ids, op4_chat, op5_url_filter, op6_mix, op7_ppm, op8_decontaminate, op9_simhash, op10_secrets, op11_divergence, op12_fim, op13_caps)
QUERIES = {f.__name__: f for f in _ALL}

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE_SQL = {
    "op1_nearest": """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM c
      WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, o.vec_id, list_reduce(list_transform(list_zip(q.v, o.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.n * o.n) AS score
      FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_url_filter": f"""
WITH r(rh, rp, rv) AS (VALUES {_RULE_VALUES}),
p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
k AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, rh || rp AS rule, rv AS verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rv = 'block' DESC) AS n
  FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, p.host, p.path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path AND m.n = 1
""",
    "op8_decontaminate": r"""
WITH n AS (SELECT row_number() OVER () AS rid, doc_id, text AS t FROM documents),
i AS (SELECT item_id, text, rtrim(text, ' .' || chr(10) || chr(9) || chr(13)) AS cut FROM benchmark),
p AS (
  SELECT item_id, 'whole' AS part, text AS t FROM i
  UNION ALL SELECT item_id, 'question', CASE WHEN contains(cut, '. ') THEN regexp_extract(cut, '^(.*)\. ', 1, 's') ELSE text END FROM i
  UNION ALL SELECT item_id, 'answer', CASE WHEN contains(cut, '. ') THEN regexp_extract(cut, '^.*\. (.*)$', 1, 's') ELSE '' END FROM i),
c AS (SELECT item_id, part, list_filter(string_split_regex(translate(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM p),
e AS (SELECT rid, doc_id, list_filter(string_split_regex(translate(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM n),
k AS (SELECT *, least(5, len(w)) AS size FROM c WHERE len(w) > 0),
ps AS (SELECT DISTINCT item_id, part, size, array_to_string(w[j:j + size - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS j FROM k)),
pn AS (SELECT item_id, part, count(*) AS n FROM ps GROUP BY ALL),
ds AS (SELECT DISTINCT rid, doc_id, size, array_to_string(w[j:j + size - 1], ' ') AS sh FROM (SELECT e.*, s.size, unnest(range(1, len(w) - s.size + 2)) AS j FROM e, (SELECT DISTINCT size FROM k) s WHERE len(w) >= s.size)),
h AS (SELECT rid, doc_id, item_id, part, count(*) AS hit FROM ps JOIN ds USING (size, sh) GROUP BY ALL),
o AS (SELECT rid, doc_id, item_id, part, hit / n AS share FROM h JOIN pn USING (item_id, part)),
m AS (SELECT rid, doc_id, item_id, max(CASE WHEN part = 'whole' THEN share END) AS overlap FROM o WHERE part <> 'answer' GROUP BY ALL
  HAVING bool_or(share >= 0.8 AND (part = 'whole' OR item_id IN (SELECT item_id FROM k WHERE part = 'question' AND len(w) >= 10))))
SELECT m.doc_id, m.item_id,
  CASE WHEN EXISTS (FROM pn WHERE pn.item_id = m.item_id AND part = 'question') THEN coalesce((SELECT share FROM o WHERE o.rid = m.rid AND o.item_id = m.item_id AND o.part = 'question'), 0) ELSE 1 END::DOUBLE AS question_overlap,
  CASE WHEN EXISTS (FROM pn WHERE pn.item_id = m.item_id AND part = 'answer') THEN coalesce((SELECT share FROM o WHERE o.rid = m.rid AND o.item_id = m.item_id AND o.part = 'answer'), 0) ELSE 1 END::DOUBLE AS answer_overlap,
  overlap::DOUBLE AS overlap
FROM m
""",
    "op6_mix": mixing_sql(),
    "op10_secrets": SECRETS_SQL,
    "op4_chat": CHAT_SQL,
    "op9_simhash": simhash_sql(shingle=3, bits=3),
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v))::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
o AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(o.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT * FROM y WHERE part = 'pair' OR rank <= 10
""",
    "op12_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, length(t) AS n, list_transform(range(0, 4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::BIGINT) AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
    "op13_caps": """
WITH RECURSIVE c AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM c
      WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.r, b.r AS o, b.vec_id FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r
      WHERE list_reduce(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]), lambda x, y: x + y) / (a.n * b.n) >= 0.93),
w(r, o) AS (SELECT r, r FROM c UNION SELECT w.r, e.o FROM w JOIN e ON e.r = w.o),
m AS (SELECT w.r, min(c.vec_id) AS component_id FROM w JOIN c ON c.r = w.o GROUP BY w.r),
k AS (SELECT r, count(*) AS n FROM e GROUP BY r)
SELECT c.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.component_id, coalesce(c.vec_id = m.component_id, false) AS kept
FROM c JOIN m USING (r) LEFT JOIN k USING (r)
""",
}

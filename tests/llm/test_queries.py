"""The registered queries without SQL on small tables, against plain versions of their whole results."""

import random
import zlib

import duckdb
import pytest
import xxhash

from pipelens.llm import queries, simhash_sql, toxicity
from tests.llm.test_ppm import brute
from tests.llm.test_secrets_chat import CHAT, SCHEMA, plain_chat
from tests.llm.test_simhash import classes, plain_fingerprint
from tests.llm.test_toxicity_decontam import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    rows, labels = corpus(260, seed=12)
    rng = random.Random(7)
    for i, t in rows[:30]:  # copies with a word changed, and short texts
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2002, "one two"), (None, "one two three"), (2003, " \t\n ")]
    docs = [(i, t, "en", rng.choice(["a", "b", None]), 0) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(*r, 1, "x") for r in CHAT], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return path, rows, dict(labels)


def fold(i, n):
    return zlib.crc32(str(i).encode() if i is not None else b"") % n


def test_toxicity_query(spark, folder):
    path, rows, labels = folder
    got = queries.op2_toxicity(spark, path).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_chat_query(spark, folder):
    assert sorted(map(tuple, queries.op4_chat(spark, folder[0]).collect()), key=repr) == plain_chat(CHAT)


def test_ppm_query(spark, folder):
    got = sorted(map(tuple, queries.op7_ppm(spark, folder[0]).collect()), key=repr)
    want = sorted(brute(folder[1]), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9)


def test_simhash_query(spark, folder):
    rows = folder[1]
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    cls = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {c: min((rows[i][0] for i in range(len(rows)) if cls[i] == c and rows[i][0] is not None), default=None) for c in cls}
    want = sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, cls)), key=repr)
    assert sorted(map(tuple, queries.op9_simhash(spark, folder[0]).collect()), key=repr) == want
    assert len(set(cls)) < len(rows) - 3


def test_simhash_sql_says_the_same(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{folder[0]}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op9_simhash"])
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in queries.op9_simhash(spark, folder[0]).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_sql_hashes_are_xxh64():
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("abc é😀 xyz") for _ in range(n % 90)) for n in range(300)} - {""})
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS g", [texts])
    assert dict(con.execute(f"WITH {simhash_sql.hashes('t', 42)} SELECT g, h FROM hashed").fetchall()) == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}

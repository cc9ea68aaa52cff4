"""Fill-in-middle against a plain version, and its automata against regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelens.llm import fim, queries

CHUNK = 1 << 9
UNITS = {fim.code_points: re.compile(r".", re.S), fim.words: re.compile(r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*|[ \t-\r]+"), fim.lines: re.compile(r"[^\n]*\n|[^\n]+")}


def plain(doc_id, text, pattern):
    t = text or ""
    units = pattern.findall(t)
    assert "".join(units) == t
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, t
    return (doc_id, len(units), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, len(units), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(4)
    letters = "ab <PSM>\n\té😀ж́ "
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 63, 64, 65, 300, CHUNK, 3 * CHUNK])))) for i in range(150)]
    rows += [(i, "".join(rng.choice("xy é😀\n") for _ in range(rng.choice([700, 5000])))) for i in range(150, 190)]  # without marks, of many chunks
    rows += [(200, None), (201, ""), (None, "no id at all"), (203, "same"), (203, "same"), (204, "<P" + "x" * 40), (205, "<" * 700), (206, "x" * (CHUNK - 1) + "<P>" + "y" * 90), (207, "é" * CHUNK)]
    return rows


@pytest.mark.parametrize("unit", list(UNITS), ids=lambda f: f.__name__)
def test_texts_of_any_length(spark, monkeypatch, unit):
    monkeypatch.setattr(fim, "CHUNK", CHUNK)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "kept", 5) for i, t in rows], "doc_id long, text string, form string, `key` int").repartition(3)
    out = fim.transform(docs, unit)
    assert out.columns == ["doc_id", "text", "key", "n", "form", "prefix_units", "middle_units", "output"]
    got = out.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["again"] == r["text"] and r["key"] == 5 for r in got)
    want = [plain(i, t, UNITS[unit]) for i, t in rows]
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_units", "middle_units", "output")) for r in got), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"} and sum(len((t or "").encode()) > CHUNK for _, t in rows) > 40


def test_functions_of_chunks_compose():
    """The functions of any cutting of a text compose to those of the text, from every state."""
    rng = np.random.default_rng(2)
    for unit in UNITS:
        automaton = fim.Automaton(unit, (b"<P>", b"<S>", b"<MM>"))
        text = bytes(rng.choice(list(b"a \n<PSM>\xc3\xa9\xf0\x9f\x98\x80"), 900).tolist())
        state, total = fim.Scan(automaton, [text]).composed()
        edges = [0, *sorted(rng.integers(0, 900, 7).tolist()), 900]
        pieces = fim.Scan(automaton, [text[a:b] for a, b in zip(edges, edges[1:])])
        moves, weights = pieces.composed()
        for s in range(pieces.states):
            at, n = s, 0
            for m, w in zip(moves, weights):
                n, at = n + w[at], m[at]
            assert (at, n) == (state[0, s], total[0, s])
        assert total[0, 0] >> 32 == len(re.findall(rb"<P>|<S>|<MM>", text))


def test_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*plain(i, t, UNITS[fim.code_points])[:5], sha(plain(i, t, UNITS[fim.code_points])[5]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, queries.op12_fim(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []

"""Undoing of journals, exports of bounded size and patterns by their anchors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pipelens.functions import globs
from pipelens.operators import journal, render
from pipelens.plans import graph

MOVE = "seq long, original string, current string, digest string"


@pytest.mark.parametrize("seed", range(3))
def test_random_journals_are_undone_exactly(spark, seed):
    rng = random.Random(seed)
    start = {f"p{i}": f"f{i}" for i in range(40)}
    now, lost, moves = dict(start), set(), []
    for seq in range(120):
        a, b = rng.choice(sorted(now)), f"p{rng.randrange(60)}"
        if seq % 5 and b in now and a != b:
            continue  # mostly to free places
        moves.append((seq, a, b, now[a]))
        f = now.pop(a)
        lost |= {now[b]} if b in now else set()
        now[b] = f
    files = spark.createDataFrame([(p, f, 7) for p, f in now.items()], "path string, digest string, original int")
    plan = journal.undo_plan(spark.createDataFrame(moves, MOVE), files)
    got = {r.path: r.digest for r in journal.undone(files, plan).collect()}
    assert got == {p: f for p, f in start.items() if f not in lost} and len(lost) > 2
    assert {r.original for r in plan.where("status = 'lost'").collect()} <= {p for p, f in start.items() if f in lost}
    assert {r.status for r in plan.collect()} == {"ok", "lost"}


def test_conflicts_are_reported(spark):
    moves = [(1, "a", "b", "A"), (2, "b", "c", "A"), (3, "d", "e", "D"), (4, "f", "g", "F"), (5, "h", "i", "H"), (6, "x", "h", None), (7, "k", "k", "K"), (8, None, "z", "Z"), (9, "r", "s", "R"), (10, "s", "r", "R"), (11, "m", "n", "M")]
    files = spark.createDataFrame([("c", "A"), ("e", "other"), ("i", "H"), ("h", "X"), ("x", "new"), ("r", "R"), ("n", "M"), (None, "N")], "path string, digest string")
    plan = {r.original: (r.current, r.moves, r.status) for r in journal.undo_plan(spark.createDataFrame(moves, MOVE), files).collect()}
    # x is taken, so what is at h cannot leave, and what came from h cannot return
    assert plan == {"a": ("c", 2, "ok"), "d": ("e", 1, "changed"), "f": ("g", 1, "missing"), "h": ("i", 1, "taken"), "x": ("h", 1, "taken"), "m": ("n", 1, "ok")}
    assert journal.undo_plan(spark.createDataFrame([], MOVE), files).count() == 0


def test_places_that_were_exchanged(spark):
    moves = [(1, "a", "t", "A"), (2, "b", "a", "B"), (3, "t", "b", "A")]
    files = spark.createDataFrame([("a", "B"), ("b", "A")], "path string, digest string")
    back = journal.undone(files, journal.undo_plan(spark.createDataFrame(moves, MOVE), files))
    assert {tuple(r) for r in back.collect()} == {("a", "A"), ("b", "B")}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(journal, "MOST_DOUBLINGS", 9)
    moves = spark.range(200).select(F.col("id").alias("seq"), F.concat(F.lit("p"), "id").alias("original"), F.concat(F.lit("p"), F.col("id") + 1).alias("current"))
    assert [tuple(r) for r in journal.folded(moves).collect()] == [(199, "p0", "p200", 200, "stays")]


def test_payloads_are_bounded_and_whole(spark):
    totals = spark.range(20_000).select(F.concat(F.lit('n"é'), "id").alias("name"), (F.col("id") * 3).alias("value"), F.when(F.col("id") % 7 == 0, "gauge").alias("kind"))
    rows = render.otlp_payloads(totals, "s\"x", 5000).collect()
    assert max(len(r.payload.encode()) for r in rows) <= 5000 and len({r.export_id for r in rows}) == len(rows) < 600
    got = {}
    for r in rows:
        found = json.loads(r.payload)["resourceMetrics"][0]
        assert found["resource"]["attributes"][0]["value"]["stringValue"] == 's"x'
        assert len(found["scopeMetrics"][0]["metrics"]) == r.n
        for m in found["scopeMetrics"][0]["metrics"]:
            assert m["name"] not in got
            got[m["name"]] = (int(m.get("sum", m.get("gauge"))["dataPoints"][0]["asInt"]), "gauge" in m, m.get("sum", {}).get("isMonotonic"))
    assert got == {f'n"é{i}': (3 * i, i % 7 == 0, None if i % 7 == 0 else True) for i in range(20_000)}
    assert render.otlp_payloads(totals.where("value < 0"), "s").count() == 0


@pytest.mark.parametrize("match", [globs.matches, globs.matches_prefix])
def test_anchors_lose_no_pattern(spark, match):
    rng = random.Random(1)
    bit = lambda: rng.choice(["*", "**", "**/", "?", "/", "a", "b", ".py", "src", "[ab]", "[^a]", "["])
    patterns = sorted({"".join(bit() for _ in range(rng.randrange(1, 6))) for _ in range(150)} | {"*foo*", "**", "**/*.py", "Makefile", "***"})
    part = lambda: "".join(rng.choice(["a", "b", "src", ".py", "foo", "["]) for _ in range(rng.randrange(1, 4)))
    paths = sorted({"/".join(part() for _ in range(rng.randrange(1, 4))) for _ in range(12)} | {"x/Makefile"})
    files = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    got = {r.pattern for r in graph.fitting_patterns(spark.createDataFrame([(p,) for p in patterns] + [(None,)], "pattern string"), files, match).collect()}
    want = files.agg(*(F.coalesce(F.bool_or(match(F.col("path"), p)), F.lit(False)).alias(f"c{i}") for i, p in enumerate(patterns))).first()
    assert got == {p for p, hit in zip(patterns, want) if hit} and 20 < len(got) < len(patterns)


def test_many_patterns_without_a_head(spark):
    patterns = spark.range(20_000).select(F.concat(F.lit("**/*.x"), "id").alias("pattern"))
    files = spark.createDataFrame([("a/b.x17",), ("c.x19999",), ("d.x",)], "path string")
    assert {r.pattern for r in graph.fitting_patterns(patterns, files).collect()} == {"**/*.x17", "**/*.x19999"}

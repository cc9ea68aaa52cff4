"""Workspace sources, repairs, reports and streams that no table query reaches."""

import hashlib
import hmac

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pipelens.functions import globs, hashing
from pipelens.operators import diagnose, heal, layout, stats
from pipelens.plans import graph
from pipelens.sources import workspace
from pipelens.streaming import streams
from tests.test_streams import drained


def test_scan_leaves_ignored_folders_out(spark, tmp_path):
    root = tmp_path / "ws"
    for name, text in (("main.go", "x"), ("docs/a.md", "yy"), ("bin/tool", "z"), ("a/venv/b.py", "z"), ("a/venvs/b.py", "w"), (".git/config", "z")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {r.path: r for r in workspace.scan_workspace(spark, str(root)).collect()}
    assert set(got) == {"main.go", "docs/a.md", "a/venvs/b.py"}
    assert got["main.go"].is_root and got["main.go"].language == "go" and got["docs/a.md"].category == "docs"
    assert got["main.go"].sha256 == hashlib.sha256(b"x").hexdigest() and got["docs/a.md"].size == 2


def test_every_wild_pattern_is_walked_for(spark):
    files = spark.createDataFrame([(p,) for p in ("a.go", "x/b.go", "x/c.py", "x/y/d.py", "dist/e.py", "x/dist/f.py", "x/c.py")], "path string")
    got = lambda *p: [r.path for r in workspace.matched_files(files, list(p)).collect()]
    assert got("**/*.go", "**/*.py") == ["a.go", "x/b.go", "x/c.py", "x/y/d.py"]  # the second one below folders too
    assert got("./x/../a.go", "missing.go") == ["a.go"] and got("dist/*") == ["dist/e.py"] and got() == []
    assert got("x/dist/**") == ["x/dist/f.py"]


@pytest.mark.parametrize("path,clean", [("./a//b/", "a/b"), ("a/../../b", "../b"), (".", "."), ("a\\b", "a/b"), ("", ".")])
def test_clean_path(path, clean):
    assert workspace.clean_path(path) == clean


def test_config_roots_of_the_workspace_itself(spark):
    files = spark.createDataFrame([("tasks.json",), ("a/b/tasks.json",), ("a/tasks.jsonx",)], "path string")
    starts = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/b/c/d",)], "start string")
    got = {r.start: (r.root, r.config) for r in workspace.config_roots(starts, files).collect()}
    assert got == {"": ("", "tasks.json"), "a": ("", "tasks.json"), "a/b": ("a/b", "a/b/tasks.json"), "a/b/c/d": ("a/b", "a/b/tasks.json")}
    none = workspace.config_roots(starts.where("start = 'a'"), files.where("false")).first()
    assert (none.root, none.config) == ("a", "a/tasks.json")


def test_empty_workspace_tables(spark):
    none = spark.createDataFrame([], "path string, text string, size long, mtime timestamp")
    assert workspace.workspace_tasks(none).count() == workspace.cache_inventory(none).count() == workspace.blob_inventory(none).count() == workspace.packages(none, ["*"]).count() == 0


SNIPPETS = [
    ("expected ':' line 1", "if x\n", "if x:", "if x:"), ("IndentationError: line 2", "for a in b:\nx", "    x", "    x"), ("'(' was never closed, line 1", "f(a[0", None, "f(a[0])"[:-2] + ")]"),
    ("invalid syntax", "retun iff 1", "retun if 1", "retun if 1"), ("invalid syntax", "x = 1 ,;,", None, "x = 1 ,;"), ("odd", "def f()", None, "def f():"), ("odd", "plain", None, None),
]


def test_both_engines(spark):
    rows = spark.createDataFrame([(i, m, c, "python") for i, (m, c, _, _) in enumerate(SNIPPETS)], "id int, diagnostic string, code string, language string")
    for engine, at in (("rules", 2), ("sidecar", 3)):
        got = {r.id: r for r in heal.heal(rows, engine).collect()}
        for i, want in ((i, s[at]) for i, s in enumerate(SNIPPETS)):
            assert (got[i].replace_block if got[i].success else None) == want, (engine, i)
    assert heal.heal(rows.where("false")).count() == 0
    null = heal.heal(spark.createDataFrame([(None, "x", "go"), ("e", None, "go")], "diagnostic string, code string, language string")).collect()
    assert not any(r.success for r in null)


def test_diff_blocks_take_the_last_hunk(spark):
    diff = "--- a\n+++ b\n@@ -3 +3 @@\n-old\n-older\n+new\n context\n@@ -12,2 +12 @@\n-x"
    r = spark.range(1).select(heal.diff_blocks(F.lit(diff)).alias("d"), heal.diff_blocks(F.lit("")).alias("e")).first()
    assert tuple(r.d) == ("old\nolder\nx\n", "new\n", 12) and tuple(r.e) == ("", "", 1)


def test_signatures_are_verified(spark):
    sign = lambda key, x: hmac.new(key, x.encode(), "sha256").hexdigest()
    long = b"k" * 100
    rows = [("m", sign(long, "m")), ("m", sign(long, "m").upper()), ("m", sign(b"k", "m")), ("m", ""), ("m", None), (None, sign(long, "m")), ("é", sign(long, "é")), ("m", "zz")]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [r[0] for r in df.select(hashing.verify_hmac(long)(F.col("t"), F.col("s"))).collect()] == [True, True, False, False, False, False, True, False]


def test_levels_of_deep_wide_and_cyclic_graphs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(i, i + 7) for i in range(0, 50, 3)] + [(1000, i) for i in range(0, 60, 5)]
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e} | {5000}], "node long")
    frame = spark.createDataFrame(edges, "src long, dst long")
    level: dict = {}

    def depth(n):
        if n not in level:
            level[n] = max((depth(a) + 1 for a, b in edges if b == n), default=0)
        return level[n]

    got = {r.node: r.level for r in graph.levels(nodes, frame).collect()}
    assert got == {r.node: depth(r.node) for r in nodes.collect()}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, frame.union(spark.createDataFrame([(59, 30)], "src long, dst long")))
    assert graph.levels(nodes.where("false"), frame).count() == 0


def test_agent_matcher_differs_from_the_general_one(spark):
    tasks = spark.createDataFrame([("a", ["src/**/*.go"], []), ("b", ["*.md"], ["a"]), ("c", [], ["b"])], "name string, inputs array<string>, depends_on array<string>")
    changed = spark.createDataFrame([("src/x.py",), ("docs\\r.md",)], "path string")
    kinds = lambda m: {r.node: r.kind for r in graph.affected_by_paths(tasks, changed, m).collect()}
    assert kinds(globs.matches) == {"b": "direct", "c": "downstream"}
    assert kinds(globs.matches_prefix) == {"a": "direct", "b": "downstream", "c": "downstream"}


def test_doctor_without_a_definition(spark):
    blobs = spark.createDataFrame([], "size long")
    report = diagnose.doctor_report(None, blobs, True, "4 cores")
    assert [(r.category, r.status) for r in report.collect()] == [("Configuration", "FAIL"), ("Cache Storage", "OK"), ("Version Control", "OK"), ("System Resources", "OK")]
    assert tuple(diagnose.doctor_result(report).first()) == (1, 1)
    fine = spark.createDataFrame([("a", ["b"]), ("b", [])], "name string, depends_on array<string>")
    assert diagnose.doctor_report(fine, blobs, True, "").where("status = 'FAIL'").count() == 0


def test_tally_and_advice_of_nothing(spark):
    none = spark.createDataFrame([], "passed boolean, is_root boolean, category string, role string")
    assert tuple(stats.tally(none).first()) == (0, 0, "PASS") and layout.advice(none).count() == 0


def test_the_last_chunk_is_flushed(spark, tmp_path):
    rows = [("s", 0, "one\ntok", False), ("s", 1, "en=abcdefgh1", True), ("t", 0, "a\n", False), ("t", 1, "", True), ("u", 0, "waits", False)]
    for n, r in enumerate(rows):
        pd.DataFrame([r], columns=["stream", "seq", "chunk", "done"]).to_json(tmp_path / f"{n}.json", orient="records", lines=True)
    source = spark.readStream.schema("stream string, seq long, chunk string, done boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = drained(streams.redact_chunks(source, last="done"), "flushed")
    assert sorted((r.stream, r.line) for r in got) == [("s", "one"), ("s", "token=***REDACTED***"), ("t", "a")]


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    schema = "path string, mtime timestamp, size long"
    none, seen, folder = spark.createDataFrame([], schema), [], f"file://{tmp_path}/last"
    handle = lambda: streams.watch(None, lambda changes, epoch: seen.append(sorted((r.path, r.change) for r in changes.collect())), none, folder)
    frame = lambda rows: spark.createDataFrame([(p, pd.Timestamp(t, unit="s").to_pydatetime(), 1) for p, t in rows], schema)
    handle()(frame([("a", 1)]), 0)
    handle()(frame([("a", 2), ("b", 1)]), 1)
    handle()(frame([("a", 2), ("b", 1)]), 1)  # the same batch again
    handle()(frame([("b", 1)]), 2)
    assert seen == [[("a", "new")], [("a", "changed"), ("b", "new")], [("a", "changed"), ("b", "new")], [("a", "deleted")]]


def test_ticks_are_beacons(spark):
    ticks = streams.beacon_ticks(spark, "n1", "127.0.0.1:1")
    assert ticks.isStreaming and ticks.columns == ["node_id", "addr", "ts", "seq"]


def test_a_busy_bucket_is_that_of_the_replay(spark):
    from tests.test_streams import replay

    times = sorted([(i * 37 % 900) * 20.0 for i in range(700)])
    rows = [("k" if i % 50 else None, i, pd.Timestamp(t, unit="s").to_pydatetime()) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    got = [(r.key, r.wait_ms) for r in streams.token_bucket(df, 0.05, 3.0).orderBy("id").collect()]
    for key in ("k", None):
        assert [w for k, w in got if k == key] == pytest.approx(replay([t for t, r in zip(times, rows) if r[0] == key], 0.05, 3.0), abs=0.5)


def test_expressions_of_patterns_fit_the_same_paths(spark):
    import random

    rng = random.Random(9)
    parts = ["a", "b", "ab", "*", "?", "**", "[ab]", "[^a]", "\\*", ".go", "/", "/", "x+y"]
    patterns = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(260)} | {"*.go", "a/**", "a/**/b", "**/*.go", "a/**/*.go", "[a", "a**b", "**", "a/b", ""})
    pieces = ["a", "b", "ab", "abc", "x+y", ".go", "*", "\n"]
    files = sorted({"/".join("".join(rng.choice(pieces) for _ in range(rng.randrange(0, 3))) for _ in range(rng.randrange(1, 4))) for _ in range(300)})
    df = spark.createDataFrame([(f,) for f in files], "path string").coalesce(1)
    for match in (globs.matches, globs.matches_prefix):
        for at in range(0, len(patterns), 60):
            some = patterns[at : at + 60]
            made = [globs.as_regex(p, match) for p in some]
            rows = df.select("path", F.array(*(match(F.col("path"), p) for p in some)).alias("want"), F.array(*(F.col("path").rlike(r) for _, r in made)).alias("got")).collect()
            for r in rows:
                for p, (head, regex), want, got in zip(some, made, r.want, r.got):
                    assert want == got, (match.__name__, p, r.path, regex)
                    assert not want or r.path.startswith(head), (p, r.path, head)

"""Operators on small tables against loops: graphs, pruning, differences, environment, layout, diagnosis, sources."""

import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from pipelens.operators import diagnose, diff, env, layout, stats, store
from pipelens.plans import graph
from pipelens.sources import config


def pairs(df):
    return sorted(map(tuple, df.collect()))


# ---------------------------------------------------------------- graphs


def edges(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"src {kind}, dst {kind}")


def random_dag(seed, n):
    rng = random.Random(seed)
    return sorted({(rng.randrange(i), i) for i in range(1, n) for _ in range(rng.randrange(3))})


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_closure_and_critical_paths(spark, seed):
    rows, n = random_dag(seed, 40), 40
    before = {i: [a for a, b in rows if b == i] for i in range(n)}
    after = {i: [b for a, b in rows if a == i] for i in range(n)}
    level: dict = {}
    for i in range(n):
        level[i] = 1 + max((level[a] for a in before[i]), default=-1)
    rng = random.Random(seed)
    dur = {i: rng.randrange(1, 9) * 1000 for i in range(n)}
    cp: dict = {}
    for i in reversed(range(n)):
        cp[i] = dur[i] + max((cp[b] for b in after[i]), default=0)
    e = edges(spark, rows, "long")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    assert dict(pairs(graph.levels(nodes, e))) == level
    assert dict(pairs(graph.critical_paths(spark.createDataFrame(list(dur.items()), "node long, duration long"), e))) == cp
    depth, todo = {3: 0}, [3]
    while todo:
        x = todo.pop(0)
        for y in after[x]:
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    assert dict(pairs(graph.closure(e, spark.createDataFrame([(3,)], "n long")))) == depth
    got = graph.affected(nodes, e, spark.createDataFrame([(3,)], "n long")).collect()
    assert {r.node: r.kind for r in got} == {k: "direct" if not d else "downstream" for k, d in depth.items()}


def test_batches_fan_in_islands_and_ties(spark):
    rows = [(f"w{i:02}", "agg") for i in range(20)]
    tasks = spark.createDataFrame([(f"w{i:02}", 1000) for i in range(20)] + [("agg", 500), ("lone", 5000)], "node string, duration long")
    e = edges(spark, rows)
    got = graph.batches(graph.levels(tasks.select("node"), e), graph.critical_paths(tasks, e)).orderBy("level", "position").collect()
    assert [r.node for r in got] == ["lone", *(f"w{i:02}" for i in range(20)), "agg"]


def test_cycles_are_refused_and_named(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("s", "s"), ("c", "d"), ("p", "q"), ("q", "p"), ("0", "a")]
    e = edges(spark, rows)
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")]
    assert pairs(graph.cycle_members(e)) == want
    assert pairs(graph.cycle_members(e, small=0)) == want
    nodes = e.select("src").union(e.select("dst")).distinct().withColumnRenamed("src", "node")
    with pytest.raises(ValueError):
        graph.levels(nodes, e)
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([("a",), ("b",)], "node string"), edges(spark, [("a", "b"), ("b", "a")]))


def test_components(spark):
    rows = random_dag(7, 60) + [(100, 101), (102, 101)]
    up = {x: x for r in rows for x in r}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in rows:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    assert dict(pairs(graph.components(edges(spark, rows, "long")))) == {x: find(x) for x in up}


def test_ghosts_and_suggestions(spark):
    tasks = spark.createDataFrame([("build", ["lint", "biuld"]), ("lint", []), ("self", ["self"])], "name string, depends_on array<string>")
    assert pairs(graph.ghosts(tasks)) == [("build", "biuld")]
    known, asked = ["build", "lint", "Build-all", "x", "compile", "test"], ["biuld", "buil", "LINT", "comp", "zzz", "", "tes", "bild"]
    lev = lambda a, b: _lev(a, b)
    want = sorted({(a, k) for a in asked for k in known if lev(a, k) <= 2 or (a and a.lower() in k.lower()) or k.lower() in a.lower()})
    one = lambda rows: spark.createDataFrame([(x,) for x in rows], "n string")
    assert pairs(graph.suggestions(one(asked), one(known))) == want


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", [3, 4])
def test_label_propagation(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{i:02}": f"s{rng.randrange(6)}" for i in range(24)}
    w: dict = {}
    for _ in range(40):
        u, v = rng.sample(sorted(nodes)[:20], 2)
        w[u, v] = w.get((u, v), 0) + 2.0
        w[v, u] = w.get((v, u), 0) + 2.0
    w["n00", "n00"] = 4.0
    label = dict(nodes)
    for _ in range(10):
        moved = False
        for n in sorted(nodes):
            votes: dict = {}
            for (u, v), x in w.items():
                if u == n:
                    votes[label[v]] = votes.get(label[v], 0) + x
            if votes:
                best = min(votes, key=lambda k: (-votes[k], k))
                if best != label[n]:
                    label[n], moved = best, True
        if not moved:
            break
    n_df = spark.createDataFrame(list(nodes.items()), "node string, seed string")
    w_df = spark.createDataFrame([(*k, x) for k, x in w.items()], "u string, v string, w double")
    assert dict(pairs(graph.label_propagation(n_df, w_df))) == label
    assert {r.node for r in graph.label_propagation_sync(n_df, w_df).collect()} == set(nodes)


# ---------------------------------------------------------------- store


@pytest.mark.parametrize("seed", range(3))
def test_lru_prune_is_the_loop(spark, seed):
    rng = random.Random(seed)
    now = 1_700_000_000
    blobs = [(f"{i:064x}", rng.randrange(1, 1000), now - rng.randrange(0, 20_000)) for i in range(120)]
    live = {b[0] for b in blobs if rng.random() < 0.2}
    most, age = 30_000, 15_000
    total = sum(b[1] for b in blobs)
    evicted, left = set(), total
    for d, size, t in sorted(blobs, key=lambda b: (b[2], b[0])):
        if d in live or now - t < 900:
            continue
        if now - t > age or (total > most and left > int(most * 0.9)):
            evicted.add(d)
            left -= size
        else:
            break
    df = spark.createDataFrame(blobs, "digest string, size long, t long").select("digest", "size", F.timestamp_seconds("t").alias("mtime"))
    got = store.lru_prune(df, spark.createDataFrame([(d,) for d in live], "digest string"), F.timestamp_seconds(F.lit(now)), most, age)
    assert {r.digest for r in got.collect() if r.evict} == evicted
    stats_row = store.prune_stats(got).first()
    assert (stats_row.n_evicted, stats_row.bytes_left) == (len(evicted), left)


def test_small_prune_by_hand(spark):
    rows = [("b1", 1000, 3), ("b2", 1000, 2), ("b3", 1000, 1)]
    df = spark.createDataFrame(rows, "digest string, size long, h int").select("digest", "size", F.timestamp_seconds(F.lit(10**9) - F.col("h") * 3600).alias("mtime"))
    got = store.lru_prune(df, df.where("false"), F.timestamp_seconds(F.lit(10**9)), 1500, 10**9, 0.1, True)
    assert {r.digest for r in got.collect() if r.evict} == {"b1", "b2"}


def test_put_sync_and_lookup(spark, tmp_path):
    df = store.with_digest(spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "content string"), "content")
    new = store.put(df, df.where("content = 'z'"))
    assert sorted(r.content for r in new.collect()) == ["x", "y"]
    store.write_blobs(new.select("digest", "content"), str(tmp_path / "cas"))
    assert spark.read.parquet(str(tmp_path / "cas")).count() == 2
    assert store.corrupted(df.withColumn("content", F.lit("q"))).count() == 4
    assert store.sync_report(df.withColumn("digest", F.when(F.col("content") == "y", "f" * 64).otherwise(F.col("digest")))).first()[:2] == (3, 1)
    peer = df.select("digest").union(spark.createDataFrame([("../x",), ("0" * 64,)], "d string"))
    assert [r.digest for r in store.peer_missing(peer, df).collect()] == ["0" * 64]
    assert {r.status for r in store.cache_lookup(df.select(F.col("digest").alias("action_hash")), df.select(F.col("digest").alias("action_hash"))).collect()} == {"CACHED"}
    assert store.dedup(df.withColumn("i", F.monotonically_increasing_id()).withColumn("size", F.lit(1)), "i").count() == 3


def test_beacons(spark):
    rows = [("a", "n1", 100, 1), ("a", "n2", 130, 2), ("b", "old", 40, 3), ("c", "ahead", 170, 4), ("d", "edge", 165, 5)]
    df = spark.createDataFrame(rows, "addr string, node_id string, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    got = store.beacon_peers(df, F.timestamp_seconds(F.lit(150)))
    assert {r.addr: r.node_id for r in got.collect()} == {"a": "n2", "d": "edge"}


# ---------------------------------------------------------------- differences, environment, layout


def test_why_has_one_reason_each(spark):
    schema = "task string, command string, file_hashes map<string,string>, env_vars map<string,string>, dep_hashes map<string,string>"
    old = [("cmd", "a", {}, {}, {}), ("file", "a", {"f": "1", "g": "1"}, {}, {}), ("gone", "a", {"f": "1"}, {}, {}), ("env", "a", {}, {"E": "1"}, {}), ("dep", "a", {}, {}, {"d": "1"}), ("same", "a", {"f": "1"}, {"E": "1"}, {"d": "1"})]
    new = [("cmd", "b", {"f": "1"}, {}, {}), ("file", "a", {"f": "2", "g": "2"}, {}, {}), ("gone", "a", {}, {}, {}), ("env", "a", {}, {"E": "1", "F": "2"}, {}), ("dep", "a", {}, {}, {"d": "2"}), ("same", "a", {"f": "1"}, {"E": "1"}, {"d": "1"}), ("new", "a", {}, {}, {})]
    got = diff.why(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert {r.task: (r.reason, r["item"]) for r in got} == {
        "cmd": ("command changed", ""), "file": ("file modified", "f"), "gone": ("file deleted", "f"), "env": ("environment variable added", "F"), "dep": ("dependency rebuilt", "d"), "same": (None, None), "new": ("no previous manifest", ""),
    }


def test_runs_with_missing_files_match(spark):
    a = spark.createDataFrame([("x", None, 0), ("y", "1", 1)], "path string, sha256 string, size long")
    b = spark.createDataFrame([("x", None, 0), ("y", "2", 1), ("z", "3", 1)], "path string, sha256 string, size long")
    assert {r.path: (r.status, r.match) for r in diff.run_compare(a, b).collect()} == {"x": ("NONE", True), "y": ("MISMATCH", False), "z": ("ONLY_SECOND", False)}


def test_env_precedence_and_lines(spark):
    files = spark.createDataFrame([(".env", "A=1\nB=2\r\n\n"), (".env.local", "A=9\nC=3"), ("empty", "")], "path string, text string")
    lines = env.lines_of(files, "path", "text")
    assert pairs(lines.where("file = '.env'")) == [(".env", 1, "A=1"), (".env", 2, "B=2"), (".env", 3, "")]
    assert dict(pairs(env.precedence(lines, {".env": 0, ".env.local": 1}))) == {"A": "1", "B": "2", "C": "3"}
    assert env.audit(files.withColumn("text", F.lit("API_KEY=longsecret"))).first()[:] == (2, 2, "VULNERABLE")


def test_target_presets(spark):
    df = spark.createDataFrame([("x/main.go", "code", "entry"), ("a.go", "code", "model"), ("b.md", "docs", ""), ("go.mod", "root_anchor", ""), ("c.go", "code", "unknown")], "p string, c string, r string")
    at = lambda preset, cluster="": [tuple(r[0]) for r in df.select(layout.target(F.col("p"), F.col("c"), F.col("r"), F.lit(cluster), preset)).collect()]
    assert at("standard") == [("cmd/app/main.go", "main"), ("internal/models/a.go", "models"), ("docs/b.md", ""), ("go.mod", ""), ("internal/core/c.go", "core")]
    assert at("clean") == [("infra/cmd/main.go", "main"), ("domain/a.go", "domain"), ("docs/b.md", ""), ("go.mod", ""), ("domain/c.go", "domain")]
    assert at("standard", "pay")[4] == ("internal/pay/c.go", "pay")


def test_package_edges(spark):
    f = spark.createDataFrame([("pay", ["lib/cart", "os"]), ("cart", ["lib/pay2"]), ("pay", ["pay"]), ("", ["cart"])], "package string, imports array<string>")
    assert pairs(layout.package_edges(f)) == [("cart", "pay"), ("pay", "cart")]


def test_repairs_and_messages(spark):
    df = spark.createDataFrame([("def f(x)", "expected ':'"), ("print((1", "'(' was never closed"), ("x = 1", "expected an indented block"), ("ok", "other")], "line string, message string")
    assert [r[0] for r in df.select(diagnose.repair(F.col("line"), F.col("message"))).collect()] == ["def f(x):", "print((1))", "    x = 1", "ok"]
    m = spark.createDataFrame([("Error at Line 7: x",), ("line 99",), ("none",)], "m string")
    assert [r[0] for r in m.select(diagnose.error_line(F.col("m"), F.lit(10))).collect()] == [7, 10, 1]
    assert [r[0] for r in spark.createDataFrame([("sh: foo: not found",), ("x",)], "m string").select(diagnose.missing_name(F.col("m"))).collect()] == ["foo", "executable"]


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2, 3, 3)] + [("b", 7.0), ("b", None)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in stats.duration_distribution(df, "k", "v").collect()}
    assert got == {"a": (6, 1.0, 3.0, 5.0, 5.0), "b": (1, 7.0, 7.0, 7.0, 7.0)}
    assert [r.n for r in stats.histogram(df, "v", (1, 3)).orderBy(F.col("le").asc_nulls_last()).collect()] == [1, 3, 3]
    ready = spark.createDataFrame([("A", 10.0, 0), ("B", 12.0, 100)], "name string, cp double, t long").withColumn("ready_at", F.timestamp_seconds("t"))
    assert [r.name for r in stats.aging_order(ready).collect()] == ["A", "B"]


# ---------------------------------------------------------------- sources


def test_task_files(spark, tmp_path):
    (tmp_path / "packages/ui").mkdir(parents=True)
    (tmp_path / "tasks.json").write_text(json.dumps({"default": "build", "tasks": {"build": {"command": "x", "outputs": ["o"], "weight": -3, "depends_on": ["ui#build"]}, "lint": {"pure": True, "other": 1}}}))
    (tmp_path / "packages/ui/tasks.json").write_text(json.dumps({"tasks": {"build": {"command": "y", "depends_on": ["gen", "core#x"]}}}))
    got = {r.name: r for r in config.workspace(spark, str(tmp_path), {"ui": "packages/ui"}).collect()}
    assert set(got) == {"build", "lint", "ui#build"}
    assert got["ui#build"].depends_on == ["ui#gen", "core#x"] and got["build"].weight == 1 and got["build"].pure and got["lint"].pure and not got["ui#build"].pure
    (tmp_path / "bad.json").write_text('{"tasks": {"a": ')
    assert config.tasks_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_file_sources(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "d").mkdir(parents=True)
    (root / "a.txt").write_text("hello")
    (root / "d/b.txt").write_text("x" * 100)
    digests = config.file_digests(spark, str(root), 50)
    got = {r.path: (r.size, r.sha256) for r in digests.collect()}
    import hashlib

    assert got == {"a.txt": (5, hashlib.sha256(b"hello").hexdigest()), "d/b.txt": (100, None)}
    again = config.incremental_digests(config.file_stat(spark, str(root)), digests)
    assert {r.path: r.fresh for r in again.collect()} == {"a.txt": True, "d/b.txt": True}
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        tar.add(root / "a.txt", "a.txt")
    assert [tuple(r)[1:3] for r in config.archive_files(spark, str(tmp_path / "c.tar.gz")).collect()] == [("a.txt", 5)]
    assert sorted(r.text for r in config.text_files(spark, str(root)).collect())[0] == "hello"
    (tmp_path / "stats.json").write_text('{"t": {"last_duration_ms": 5, "exec_count": 2}}')
    assert config.json_map(spark, str(tmp_path / "stats.json")).first().value.exec_count == 2
    listing = spark.createDataFrame([(" a.go \n\nb.go\n",)], "value string")
    assert sorted(r.path for r in config.changed_paths(listing).collect()) == ["a.go", "b.go"]
    records = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "k string, at int, v string")
    config.write_records(records, str(tmp_path / "rec"))
    assert {r.k: r.v for r in config.latest(spark.read.parquet(str(tmp_path / "rec")), "k", "at").collect()} == {"k": "new", "j": "x"}

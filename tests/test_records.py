"""Provenance, rendering, SQL functions and tokens by level."""

import hashlib
import json

from pyspark.sql import functions as F

from pipelens.functions import registered
from pipelens.operators import provenance, render, stats, store
from pipelens.plans import graph


def test_statements_and_envelopes(spark):
    runs = spark.createDataFrame([("build", "go build", "h", {"b": "2", "a": "1"})], "task string, command string, hash string, output_hashes map<string,string>")
    text = provenance.statements(runs, "local").first().statement
    got = json.loads(text)
    assert [s["name"] for s in got["subject"]] == ["a", "b"] and got["predicate"]["runDetails"]["builder"]["id"] == "local"
    df = spark.createDataFrame([("é",)], "p string")
    assert df.select(provenance.pre_authentication(F.col("p"), "t")).first()[0] == "DSSEv1 1 t 2 é"
    sealed = json.loads(df.select(provenance.envelope(F.col("p"), F.lit("k"), F.lit("s"))).first()[0])
    assert sealed["signatures"] == [{"keyid": "k", "sig": "s"}]
    assert df.select(provenance.key_id(F.lit(b"x"))).first()[0] == hashlib.sha256(b"x").hexdigest()


def test_charts_and_metrics(spark):
    spans = spark.createDataFrame([("a<b", 0, 0, 50), ("c", 1, 50, 50)], "name string, batch int, start_us long, dur_us long")
    got = [r.element for r in render.flame_elements(stats.flame_geometry(spans)).orderBy("y", "x").collect()]
    assert got == ['<g><title>a&lt;b</title><rect x="0.00" y="0" width="500.00" height="22"/></g>', '<g><title>c</title><rect x="500.00" y="24" width="500.00" height="22"/></g>']
    edges = spark.createDataFrame([("lint", "build"), ("gen", "build")], "src string, dst string")
    assert sorted(r.line for r in render.dependency_lines(edges).collect()) == ["build <- gen, lint", "gen", "lint"]
    payload = render.otlp_metrics(spark.createDataFrame([("runs", 3)], "name string, value long"), "p").first().payload
    assert json.loads(payload)["resourceMetrics"][0]["scopeMetrics"][0]["metrics"][0]["sum"]["dataPoints"] == [{"asInt": "3"}]


def test_sql_functions(spark):
    registered.register(spark)
    row = spark.sql("SELECT mask_secret('abcdefgh'), merkle_digest(map('b', '2', 'a', '1')), shard_path('abcd'), is_digest(repeat('a', 64)), is_digest(repeat('.', 64)), base_name('x/y')").first()
    assert tuple(row) == ("abc...fgh", hashlib.sha256(b"a:1\nb:2\n").hexdigest(), "ab/cd", True, False, "y")
    assert [tuple(r) for r in spark.sql("SELECT * FROM env_lines('# c\nA=1\n\nB = \"x\"\nbare')").collect()] == [(2, "A", "1"), (4, "B", "x"), (5, "bare", "")]


def test_tokens_cut_chains_early(spark):
    schema = "name string, command string, cwd string, shell string, pure boolean, file_hashes map<string,string>, env_vars map<string,string>, outputs array<string>, output_digest string"
    rows = lambda src, out: spark.createDataFrame([("gen", "g", "", "", True, {"f": src}, {}, ["o"], out), ("use", "u", "", "", False, {}, {}, [], ""), ("end", "e", "", "", False, {}, {}, [], "")], schema)
    edges = spark.createDataFrame([("gen", "use"), ("use", "end")], "src string, dst string")
    level = spark.createDataFrame([("gen", 0), ("use", 1), ("end", 2)], "node string, level int")
    run = lambda src, out: {r.name: r.fingerprint for r in graph.task_tokens(rows(src, out), edges, level).collect()}
    a, b, c = run("1", "d"), run("2", "d"), run("2", "x")
    assert a["gen"] != b["gen"] and a["use"] == b["use"] and a["end"] == b["end"]
    assert c["use"] != b["use"] and c["end"] != b["end"]


def test_stale(spark):
    df = spark.createDataFrame([(0,), (100,)], "t long").withColumn("timestamp", F.timestamp_seconds("t"))
    assert [r.t for r in store.stale(df, F.timestamp_seconds(F.lit(150)), 60).collect()] == [0]

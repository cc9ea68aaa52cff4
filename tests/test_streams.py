"""Streams from files, run to their end, against the same operators on tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pipelens.streaming import streams


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_redacted_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("API_KEY=abcd1234efgh\nplain\n")
    got = drained(streams.redact_lines(spark.readStream.text(str(tmp_path))), "red_lines")
    assert sorted(r.value for r in got) == ["API_KEY=***REDACTED***", "plain"]


def test_redacted_chunks_do_not_cut_tokens(spark, tmp_path):
    text = "first\nAPI_KEY=abcd1234efgh tail\n" + "x" * 200 + " token=zzzzzzzzzz\nopen"
    for n, a in enumerate(range(0, len(text), 7)):
        pd.DataFrame([("s", n, text[a : a + 7])], columns=["stream", "seq", "chunk"]).to_json(tmp_path / f"{n:03}.json", orient="records", lines=True)
    source = spark.readStream.schema("stream string, seq long, chunk string").option("maxFilesPerTrigger", 20).json(str(tmp_path))
    got = drained(streams.redact_chunks(source), "red_chunks")
    assert sorted(r.line for r in got) == sorted(["first", "API_KEY=***REDACTED*** tail", "x" * 200 + " token=***REDACTED***"])


def test_watch_loses_nothing(spark, tmp_path):
    snapshots = [[("a", 1, 5), ("b", 1, 5)], [("a", 2, 5), ("b", 1, 5), ("c", 1, 1)], [("a", 2, 6), ("c", 1, 1)]]
    schema = "path string, mtime timestamp, size long"
    seen: list = []
    handle = streams.watch(None, lambda changes, epoch: seen.append(sorted((r.path, r.change) for r in changes.collect())), spark.createDataFrame([], schema))
    for n, rows in enumerate(snapshots):
        handle(spark.createDataFrame([(p, pd.Timestamp(t, unit="s").to_pydatetime(), s) for p, t, s in rows], schema), n)
    assert seen == [[("a", "new"), ("b", "new")], [("a", "changed"), ("c", "new")], [("a", "changed"), ("b", "deleted")]]


def test_debounced_stream_is_that_of_the_table(spark, tmp_path):
    rows = [("w", t) for t in (0, 100, 300, 900, 1000, 60_000)]
    pd.DataFrame([{"workspace": w, "ms": t} for w, t in rows]).to_json(tmp_path / "a.json", orient="records", lines=True)
    at = F.timestamp_millis("ms").alias("ts")
    table = streams.debounced(spark.read.schema("workspace string, ms long").json(str(tmp_path)).select("workspace", at))
    assert sorted(r.n for r in table.collect()) == [1, 2, 3]
    source = spark.readStream.schema("workspace string, ms long").json(str(tmp_path)).select("workspace", at)
    assert sorted(r.n for r in drained(streams.debounced(source), "bursts")) == [2, 3]  # the last burst is still open


def replay(times, rate, burst):
    tokens, last, out = burst, None, []
    for t in times:
        now = t if last is None else max(t, last)
        if last is not None:
            tokens = min(burst, tokens + (now - last) * rate)
        if tokens < 1:
            need = max((1 - tokens) / rate, 0.001)
            now, tokens = now + need, min(burst, tokens + need * rate)
        tokens, last = tokens - 1, now
        out.append((now - t) * 1000)
    return out


def test_token_bucket(spark, tmp_path):
    times = [0, 0, 0, 0.05, 0.5, 0.5, 3.0, 3.0, 3.0]
    rows = [("k", i, pd.Timestamp(t, unit="s").to_pydatetime()) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    got = [r.wait_ms for r in streams.token_bucket(df, 4.0, 2.0).orderBy("id").collect()]
    assert got == pytest.approx(replay(times, 4.0, 2.0), abs=0.01)
    df.withColumn("part", F.col("id") % 1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, id long, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.wait_ms for r in drained(streams.token_bucket_stream(source, 4.0, 2.0), "bucket")) == pytest.approx(sorted(got), abs=0.01)


def test_beacon_batches(spark):
    got: list = []
    handle = streams.beacon_batch(lambda epoch: F.timestamp_seconds(F.lit(150 + epoch)), lambda peers, epoch: got.append({r.addr for r in peers.collect()}))
    df = spark.createDataFrame([("a", "n", 100, 1), ("b", "n", 80, 2)], "addr string, node_id string, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    handle(df, 0)
    handle(df, 1)
    assert got == [{"a"}, {"a"}]

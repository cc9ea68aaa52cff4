"""Redaction in chunks against redaction of the whole, and live peers over batches."""

import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pipelens.functions.secrets import MASK, MASKED, NAMED, VALUE, redact
from pipelens.streaming import stateful

PARTS = ["key", "token", "Bearer ", "bearer\n", "password", "secret: ", "auth=", "ghp_", "sk_live_", "AKIA", "A" * 16, "abcd1234", "x" * 40, "0" * 20, " ", "\n", "=", ":", "'", '"', "plain words here ", "é", "(", ",", "-", "/", "+", ".", "monkey", "passwd  \n  "]


def plain(text):
    for p in MASKED:
        text = re.sub(p.removeprefix("(?i)"), MASK, text, flags=re.I | re.A)
    text = re.sub(rf"(?:({NAMED}\s*)[:=][\s:=]*{VALUE}|{NAMED}\s+{VALUE})", lambda m: f"\x01{m[1] or ''}\x02{MASK}", text, flags=re.I | re.A)
    return text.replace("\x01\x02", "").replace("\x01", "").replace("\x02", "=")


def texts(seed, n, most=60):
    rng = random.Random(seed)
    while n:
        text = "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 30]) for _ in range(rng.randrange(most)))
        if not re.search(r"[\s:=]{60,}", text):
            n -= 1
            yield text, rng


def test_any_cuts_give_the_redaction_of_the_whole(monkeypatch):
    monkeypatch.setattr(stateful, "GAP", 64)
    monkeypatch.setattr(stateful, "REACH", 64 + 80)
    monkeypatch.setattr(stateful, "CARRY", 400)
    for text, rng in texts(5, 1500):
        carry, rule, out, at = "", -1, "", 0
        shown = lambda t, r: plain(t)[len(stateful._SHOWN[r]) if r >= 0 else 0 :]
        while at < len(text):
            k = rng.choice([1, 2, 5, 20, 100, 400])
            pieces, carry, rule = stateful.step(carry, rule, text[at : at + k])
            out += "".join(shown(*p) for p in pieces)
            at += k
            assert len(carry) <= 400
        assert out + shown((stateful._STANDS[rule] if rule >= 0 else "") + carry, rule) == plain(text)


def test_values_and_gaps_of_any_length_stay_masked_and_bounded():
    for text in ("token=" + "a" * 50_000 + " end", "ghp_" + "b" * 50_000 + "-x", "bearer " + "c." * 30_000, "password" + " " * 50_000 + "hunter2hunter2 end", "x" * 50_000 + " key=abcdefgh1 end", "=" * 20_000 + "é", "key" * 20_000):
        carry, rule, out = "", -1, ""
        for at in range(0, len(text), 777):
            pieces, carry, rule = stateful.step(carry, rule, text[at : at + 777])
            out += "".join(plain(t)[len(stateful._SHOWN[r]) if r >= 0 else 0 :] for t, r in pieces)
            assert len(carry) <= stateful.CARRY
        out += plain((stateful._STANDS[rule] if rule >= 0 else "") + carry)[len(stateful._SHOWN[rule]) if rule >= 0 else 0 :]
        if " " * 999 in text:
            assert "hunter2" not in out and out.endswith(f"{MASK} end") and len(out) < 400
        else:
            assert out == plain(text)


@pytest.fixture
def bounded(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_bounded_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_is_the_redaction_of_the_whole(bounded, tmp_path):
    """Several streams in chunks over several batches and a restart; what is held leaves in silence."""
    spark = bounded
    whole = {f"s{n}": text + " API_KEY=unfinished1" for n, (text, _) in enumerate(texts(9, 6, 40))} | {"long": "token=" + "v" * 9000 + "\nline\nsecret: abcdefgh"}
    rng, chunks = random.Random(2), []
    for stream, text in whole.items():
        at = 0
        while at < len(text):
            k = rng.choice([3, 40, 200, 6000])
            chunks.append((stream, at, text[at : at + k]))
            at += k
    chunks.sort(key=lambda c: (c[1], c[0]))
    cuts = [0, len(chunks) // 3, len(chunks) // 2, len(chunks)]
    (tmp_path / "in").mkdir()
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        pd.DataFrame(chunks[a:b], columns=["stream", "seq", "chunk"]).to_json(tmp_path / f"in/{n}.json", orient="records", lines=True)

    def start(**trigger):
        source = spark.readStream.schema("stream string, seq long, chunk string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = stateful.redact_stream(source, idle_s=0.5)
        return out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(**trigger).start()

    start(availableNow=True).awaitTermination(120)
    # silence: a query that goes on without input gives what is held
    q = start(processingTime="200 milliseconds")
    want = {r.stream: r.text for r in spark.createDataFrame(list(whole.items()), "stream string, text string").withColumn("text", redact(F.col("text"))).collect()}
    until = time.time() + 60
    while time.time() < until:
        got: dict = {}
        for r in sorted(spark.read.schema("stream string, part long, text string").parquet(str(tmp_path / "out")).collect(), key=lambda r: r.part):
            got[r.stream] = got.get(r.stream, "") + r.text
        if got == want:
            break
        time.sleep(1)
    q.stop()
    assert got == want and want["long"] == f"token={MASK}\nline\nsecret={MASK}" and all("unfinished1" not in t for t in got.values())


def test_live_peers(bounded, tmp_path):
    """The latest of all batches counts, repeated and older beacons change nothing, and a silent address goes after a minute."""
    spark = bounded
    batches = [
        [("a", "n1", 100, 1), ("b", "n2", 100, 1), ("a", "n0", 90, 9)],
        [("a", "n3", 110, 2), ("b", "n2", 100, 1), ("b", "old", 95, 7), (None, "x", 110, 1), ("c", "n4", None, 1)],
        [("a", "n3", 150, 3)],
        [("d", "n5", 178, None)],  # the watermark is at 163: b, last seen at 100, is gone
        [("d", "n5", 250, 2)],  # at 235: a is gone as well
        [("d", "n5", 251, 3)],
    ]
    (tmp_path / "in").mkdir()
    changes, table = [], {}

    def sink(df, n):
        for r in sorted(df.collect(), key=lambda r: (r.ts, r.addr)):
            changes.append((r.addr, r.node_id, int(r.ts.timestamp()), r.state))
            table[r.addr] = r.node_id
            if r.state == "gone":
                del table[r.addr]

    for n, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["addr", "node_id", "t", "seq"]).astype({"t": "Int64", "seq": "Int64"}).to_json(tmp_path / f"in/{n}.json", orient="records", lines=True)
        source = spark.readStream.schema("addr string, node_id string, t long, seq long").json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
        q = stateful.live_peers(source).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)  # each batch is a start of its own
    want = [
        ("a", "n1", 100, "seen"), ("b", "n2", 100, "seen"), ("a", "n3", 110, "seen"), ("a", "n3", 150, "seen"),
        ("d", "n5", 178, "seen"), ("b", "n2", 100, "gone"), ("d", "n5", 250, "seen"), ("a", "n3", 150, "gone"), ("d", "n5", 251, "seen"),
    ]
    # what goes in a batch comes behind the batch that moves the watermark
    assert changes == want, changes
    assert table == {"d": "n5"}

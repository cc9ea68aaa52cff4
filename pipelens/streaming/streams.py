"""Structured Streaming forms: redaction, change detection, debouncing, rate limits, beacons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pipelens.functions.secrets import redact
from pipelens.operators.diff import snapshot_diff
from pipelens.operators.store import beacon_peers


def redact_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """A stream of log lines with credentials masked. A line is whole, so no token is cut and no state is kept."""
    return lines.withColumn(column, redact(F.col(column)))


def redact_chunks(chunks: DataFrame, key: str = "stream", at: str = "seq", text: str = "chunk", last: str | None = None) -> DataFrame:
    """(stream, line) from chunks that may cut a line: what follows the last newline waits for the next chunk.

    ``last`` names a boolean column that is true for a stream's last chunk;
    that chunk's rest is a line too, with a newline or without. Where streams
    do not say when they end, an unfinished line keeps waiting.
    """

    def join(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else ""
        data = pd.concat(list(pdfs)).sort_values(at)
        *lines, rest = (rest + "".join(data[text].fillna(""))).split("\n")
        if last and data[last].fillna(False).any():
            lines, rest = lines + [rest] * bool(rest), ""
            state.remove()
        else:
            state.update((rest,))
        yield pd.DataFrame({"stream": [k[0]] * len(lines), "line": lines})

    kind = chunks.schema[key].dataType.simpleString()
    whole = chunks.groupBy(key).applyInPandasWithState(join, f"stream {kind}, line string", "rest string", "append", GroupStateTimeout.NoTimeout)
    return whole.withColumn("line", redact(F.col("line")))


def watch(snapshots: DataFrame, on_change: Callable[[DataFrame, int], None], start: DataFrame, folder: str | None = None):
    """A batch function for ``foreachBatch``: each batch is a snapshot (path, mtime, size); changes go to ``on_change``.

    Nothing between two snapshots is lost, as each is compared with the one
    that was handled before it, which is kept in a table and not in memory.
    With ``folder``, a shared one, that table is found again after a restart,
    and a batch that is handled again meets the same predecessor.
    """
    held = {"last": start}

    def handle(batch: DataFrame, epoch: int) -> None:
        from pipelens.plans.lineage import cut

        now = batch.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("m")).select("path", "m.mtime", "m.size")
        if folder is None:
            now = cut(now)
            on_change(snapshot_diff(held["last"], now), epoch)
            held["last"] = now
            return
        spark = batch.sparkSession
        now.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(folder)
        kept = spark.read.schema("path string, mtime timestamp, size long, epoch long").parquet(folder)
        before = kept.where(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]
        last = start if before is None else kept.where(F.col("epoch") == before).drop("epoch")
        on_change(snapshot_diff(last, kept.where(F.col("epoch") == epoch).drop("epoch")), epoch)

    return handle


def debounced(changes: DataFrame, gap: str = "350 milliseconds", key: str = "workspace", at: str = "ts", late: str = "10 seconds") -> DataFrame:
    """(workspace, start, end, n) of bursts of changes that no gap of ``gap`` divides; works on streams and tables."""
    rows = changes.withWatermark(at, late) if changes.isStreaming else changes
    return rows.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def token_bucket(requests: DataFrame, rate: float, burst: float, key: str = "key", at: str = "ts", tie: str = "id", width: str = "1 hour") -> DataFrame:
    """(key, id, ts, granted_at, wait_ms): a table of requests through a bucket of ``burst`` tokens filled at ``rate`` a second.

    Each key's requests go in order; a request without a token waits for one,
    a millisecond at least. With T the time of one token, the moment at which
    the bucket is full again behind request i is the greatest of
    ``t_j + (i - j + 1) T`` over the requests j up to it, so request i is
    granted at the same maximum over those before it, less ``burst - 1`` times
    T. Numbers and maxima are taken within spans of ``width`` and over them, so
    no window holds all of a busy key.
    """
    token = 1e6 / rate
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.window(F.col(at).cast("timestamp"), width)["start"]
    own = Window.partitionBy("k", "span").orderBy("t", "tie")
    rows = requests.select(F.col(key).alias("k"), F.col(tie).alias("tie"), F.col(at).alias("at"), t.alias("t"), span.alias("span")).withColumn("i", F.row_number().over(own) - 1)
    rows = rows.withColumn("m", F.col("t") - F.col("i") * token)
    spans = rows.groupBy("k", "span").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    earlier = Window.partitionBy("k").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("m", F.col("m") - F.col("before") * token)
    spans = spans.select("k", "span", "before", F.max("m").over(earlier).alias("carry"))
    # what came before within the span, then what the spans before carry
    inside = F.max("m").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumnsRenamed({"k": "s_k", "span": "s_span"})
    rows = rows.withColumn("inside", inside).join(spans, F.col("k").eqNullSafe(F.col("s_k")) & F.col("span").eqNullSafe(F.col("s_span")))
    most = F.greatest(F.col("carry"), F.col("inside") - F.col("before") * token)
    ideal = most + (F.col("i") + F.col("before")) * token - (burst - 1) * token
    granted = F.when(ideal > F.col("t"), F.greatest(F.floor(ideal), F.col("t") + 1000)).otherwise(F.col("t")).cast("long")
    kind = requests.schema[at].dataType
    out = rows.select(F.col("k").alias(key), F.col("tie").alias(tie), F.col("at").alias(at), "t", granted.alias("g"))
    return out.select(key, tie, at, F.timestamp_micros("g").cast(kind).alias("granted_at"), ((F.col("g") - F.col("t")) / 1000).alias("wait_ms"))


def _replay(pdf: pd.DataFrame, at: str, rate: float, burst: float, tokens: float, last: int | None):
    granted, waits = [], []
    for t in pdf[at].astype("datetime64[us]").astype("int64"):
        now = t if last is None else max(t, last)
        if last is not None:
            tokens = min(burst, tokens + (now - last) * rate / 1e6)
        if tokens < 1:
            need = max((1 - tokens) / rate * 1e6, 1000.0)
            tokens = min(burst, tokens + need * rate / 1e6)
            now += int(need)
        tokens -= 1
        last = now
        granted.append(now)
        waits.append((now - t) / 1000)
    out = pdf.assign(granted_at=pd.to_datetime(pd.Series(granted, index=pdf.index, dtype="int64"), unit="us"), wait_ms=waits)
    return out, tokens, last


def token_bucket_stream(requests: DataFrame, rate: float, burst: float, key: str = "key", at: str = "ts") -> DataFrame:
    """(key, ts, wait_ms) of a stream of requests; a key's tokens and its last moment are its state."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        out, tokens, last = _replay(pd.concat(list(pdfs)).sort_values(at), at, rate, burst, tokens, None if last is None or last < 0 else last)
        state.update((float(tokens), -1 if last is None else int(last)))
        yield pd.DataFrame({"key": [k[0]] * len(out), "ts": out[at].to_numpy(), "wait_ms": out["wait_ms"].to_numpy()})

    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, at)}
    return requests.groupBy(key).applyInPandasWithState(step, f"key {kinds[key]}, ts {kinds[at]}, wait_ms double", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def beacon_batch(now: Callable[[int], object], on_peers: Callable[[DataFrame, int], None]):
    """A batch function for ``foreachBatch``: fresh peers of a batch of beacons, by the moment that ``now`` gives for it."""

    def handle(batch: DataFrame, epoch: int) -> None:
        on_peers(beacon_peers(batch, now(epoch)), epoch)

    return handle


def beacon_ticks(spark: SparkSession, node_id: str, addr: str, every_ms: int = 500) -> DataFrame:
    """A stream of this node's beacons (node_id, addr, ts, seq), one every ``every_ms`` milliseconds."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", every_ms).load()
    return ticks.select(F.lit(node_id).alias("node_id"), F.lit(addr).alias("addr"), F.col("timestamp").alias("ts"), F.col("value").alias("seq"))

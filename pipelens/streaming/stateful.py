"""Streams with state that is bounded: redaction of text in chunks, and live peers. Both need the RocksDB state store."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pipelens.functions.secrets import MASK, MASKED, NAMED, VALUE, redact

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Characters that a stream's state holds at most, and of white space and signs between a name and its value.
CARRY, GAP = 1 << 12, 256
#: Any match shows within so many characters from its start on, as it needs a name, a gap and 36 characters at most.
REACH = GAP + 80

# ---------------------------------------------------------------- redaction

_FLAGS = re.IGNORECASE | re.ASCII
_WORDS = rf"(?:bearer|{NAMED})"
#: The rules in their order, and for each the least text that it masks: what stands for a match that began in what has left.
_RULES = tuple(re.compile(p, _FLAGS) for p in (*(m.removeprefix("(?i)") for m in MASKED), rf"{NAMED}\s*[:=][\s:=]*{VALUE}|{NAMED}\s+{VALUE}"))
_STANDS = ("bearer " + "0" * 16, "ghp_" + "0" * 36, "sk_live_" + "0" * 24, "", "key=" + "0" * 8)
_SHOWN = (MASK, MASK, MASK, "", f"key={MASK}")
#: No match goes over a character that is in none of the rules, nor over white space if no name with its signs stands before that.
_BREAK = re.compile(r"""[^A-Za-z0-9_\-.+/=:'"\s]""", re.ASCII)
_OPEN = re.compile(rf"{_WORDS}[\s:=]*\Z", _FLAGS)
_SPACE = re.compile(r"\s", re.ASCII)


def _squeezed(text: str) -> str:
    """Of more than GAP characters between a name and its value the middle is left out, so the two are never parted."""
    short = lambda m: m[1] + m[2][: GAP // 2] + ("=" if re.search("[:=]", m[2]) else " ") + m[2][1 - GAP // 2 :]
    return re.sub(rf"({_WORDS})([\s:=]{{{GAP + 1},}})", short, text, flags=_FLAGS)


def _matches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of what is masked in a text, in order; a rule does not see what those before it have masked."""
    out = []
    for n, rule in enumerate(_RULES):
        for a, b in [m.span() for m in rule.finditer(text)]:
            out.append((a, b, n))
            text = text[:a] + "*" * (b - a) + text[b:]
    return sorted(out)


def _free(text: str, spans: list[tuple[int, int, int]], most: int) -> int:
    """The last place up to ``most`` that no match goes over."""
    for a, b, _ in reversed(spans):
        if a < most < b:
            most = a
    return most


def _plain_cut(text: str) -> int:
    """The last place over which no match goes, whatever follows."""
    best = max((m.end() for m in _BREAK.finditer(text)), default=0)
    for at in reversed([m.start() for m in _SPACE.finditer(text, best)]):
        if not _OPEN.search(text[max(0, at - GAP - 16) : at]):
            return max(best, at)
    return best


def step(carry: str, rule: int, chunk: str) -> tuple[list[tuple[str, int]], str, int]:
    """What leaves, as (text, rule), and the new state (carry, rule), after one more chunk.

    With a rule, 0 or more, the text goes on a match of that rule whose mask
    has left. It stands behind ``_STANDS`` then, and of its redaction
    ``_SHOWN`` is dropped.
    """
    text = _squeezed((_STANDS[rule] if rule >= 0 else "") + carry + chunk)
    least = len(_STANDS[rule]) if rule >= 0 else 0
    spans, out = _matches(text), []
    at = max(_plain_cut(text), _free(text, spans, max(0, len(text) - REACH)))
    if at > least:
        out.append((text[:at], rule))
        text, rule, spans = text[at:], -1, [(a - at, b - at, n) for a, b, n in spans if a >= at]
    if len(text) > CARRY:  # one match goes over all that is sure of it
        at = len(text) - REACH
        on = next(n for a, b, n in spans if a < at < b)
        out.append((text[:at], rule))
        text, rule = text[at:], on
        return out, text, rule
    return out, text[len(_STANDS[rule]) if rule >= 0 else 0 :], rule


class _Redactor(StatefulProcessor):
    """Holds what a later chunk can still be part of, CARRY characters at most."""

    def __init__(self, idle_ms: int, text: str, at: str):
        self.idle_ms, self.text, self.at = idle_ms, text, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carry", "text string, rule int, part long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carry, rule, part = self.state.get() if self.state.exists() else ("", -1, 0)
        out: list[tuple[str, int]] = []
        for chunk in pd.concat(list(rows)).sort_values(self.at, kind="stable")[self.text]:
            for lo in range(0, len(chunk), CARRY):  # a chunk of any size, a piece at a time
                pieces, carry, rule = step(carry, rule, chunk[lo : lo + CARRY])
                out += pieces
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((carry, rule, part + len(out)))
        if carry:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _rows(key, part, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The stream was silent: what it holds leaves; what follows of a value that is masked by that stays masked."""
        carry, rule, part = self.state.get() if self.state.exists() else ("", -1, 0)
        if carry:
            text = (_STANDS[rule] if rule >= 0 else "") + carry
            on = next((n for a, b, n in _matches(text) if b == len(text) and _STANDS[n]), -1)
            self.state.update(("", on, part + 1))
            yield _rows(key, part, [(text, rule)])

    def close(self) -> None:
        pass


def _rows(key: tuple, part: int, pieces: list[tuple[str, int]]) -> pd.DataFrame:
    rows = [(key[0], part + n, text, rule) for n, (text, rule) in enumerate(pieces)]
    return pd.DataFrame(rows, columns=["stream", "part", "text", "rule"], dtype=object)


def shown(text: Column, rule: Column) -> Column:
    """What a piece that leaves looks like."""
    masked = redact(text)
    return F.when(rule < 0, masked).otherwise(F.substring(masked, F.length(F.get(F.array(*map(F.lit, _SHOWN)), rule)) + 1, F.length(masked)))


def redact_stream(chunks: DataFrame, key: str = "stream", at: str = "seq", text: str = "chunk", idle_s: float = 5.0) -> DataFrame:
    """(stream, part, text) of a stream of chunks, cut anywhere, in the order of ``at``: put together by ``part``, ``redact`` of the whole text.

    Text leaves as soon as no match can go over its end: at the latest after
    ``idle_s`` seconds of silence, so unfinished lines do not wait for ever. A
    stream's state is ``CARRY`` characters and two numbers at most, however long
    a line or a value is. It differs from redacting the whole where that cannot
    be known with so much: of more than ``GAP`` characters of white space and
    signs between a name and its value the middle is left out, and what left in
    a silence is not masked later, though what goes on a value that was masked
    by then stays masked. Null chunks are empty.
    """
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("stream"), F.col(at), F.coalesce(text, F.lit("")).alias(text)).groupBy("stream")
    pieces = rows.transformWithStateInPandas(_Redactor(int(idle_s * 1000), text, at), f"stream {kind}, part long, text string, rule int", "Append", "ProcessingTime")
    return pieces.select("stream", "part", shown(F.col("text"), F.col("rule")).alias("text"))


# ---------------------------------------------------------------- peers


class _Peers(StatefulProcessor):
    """The last beacon of an address; a timer takes it away."""

    def __init__(self, window_ms: int, ahead_ms: int):
        self.window_ms, self.ahead_ms = window_ms, ahead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "node_id string, at long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        best = last = self.state.get() if self.state.exists() else None
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            # of moments that are ahead of the watermark's by more than clocks may differ, none is believed
            for node, t, seq in zip(pdf["node_id"], at, pdf["seq"]):
                new = (node, int(t), int(seq))
                if now > 0 and t <= now - self.window_ms:
                    continue
                if best is None or (new[1], new[2], new[0] or "") > (best[1], best[2], best[0] or ""):
                    best = new
        if best is None or best == last:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[1] + self.window_ms)
        self.state.update(best)
        yield _peer(key, best, "seen")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last = self.state.get()
            self.state.clear()
            yield _peer(key, last, "gone")

    def close(self) -> None:
        pass


def _peer(key: tuple, last: tuple, state: str) -> pd.DataFrame:
    row = pd.DataFrame([(key[0], last[0], None, last[2], state)], columns=["addr", "node_id", "ts", "seq", "state"], dtype=object)
    return row.assign(ts=pd.to_datetime([last[1]], unit="ms"))


def live_peers(beacons: DataFrame, window_s: int = 60, late: str = "15 seconds") -> DataFrame:
    """(addr, node_id, ts, seq, state): a row for each change of the table of peers, from a stream of beacons (addr, node_id, ts, seq).

    ``seen`` replaces what is known of the address: of all batches the beacon
    of the greatest (ts, seq) counts, and one that is older than the last
    changes nothing. ``gone`` takes the address away, ``window_s`` seconds after
    its last beacon by the watermark, which is ``late`` behind the latest of all
    beacons. Equal (ts, seq) go to the greater node. Beacons without an address
    or a moment take no part; a null ``seq`` counts as 0. Addresses are the
    keys, so no task holds the table.
    """
    rows = beacons.where("addr IS NOT NULL AND ts IS NOT NULL").select("addr", "node_id", "ts", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    kind = beacons.schema["addr"].dataType.simpleString()
    out = f"addr {kind}, node_id string, ts timestamp, seq long, state string"
    return rows.withWatermark("ts", late).groupBy("addr").transformWithStateInPandas(_Peers(window_s * 1000, 15_000), out, "Update", "EventTime")


def use_bounded_state(spark: SparkSession) -> None:
    """Choose the state store that the streams of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

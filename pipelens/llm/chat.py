"""Chat formatting by quotation linking.

Messages quote with leading ``>`` marks, nested at will. Of every run of lines
that are quoted equally deep the whole, the paragraphs and the lines are quoted
passages; normalised (no marks, A-Z lower-cased, white space joined) and
hashed, they are joined to the paragraphs and lines that earlier messages of
the conversation wrote themselves. The deepest level is the oldest text, so the
message answered is the latest one matched at the lowest level. Conversations
come out without quotes, every message behind the thread it answers.

Messages are parsed once. The join is an as-of join: quotes and passages of one
hash are sorted by turn, and the latest passage before a quote is carried
along, within buckets of ``TURNS`` turns and over them, so that a line written
a million times in one conversation is not one group. Positions come from one
range sort of all messages and from counts of each conversation's rows in the
partitions before, so a conversation may fill any number of tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import cut

MARKS = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
#: A line that only introduces a quote, as mail programs write it, ends so; it goes with the quote.
LEAD_IN = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió)[^\n]{0,40}:$", re.I)
#: Turns of a bucket of the as-of join.
TURNS = 4096


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """A message's own text, its quoted passages (level, hash) and the hashes of its own paragraphs and lines.

    Passages without words are left out. A quoted run counts as a whole, by
    paragraphs and line by line, so that a quote of a part still finds its
    message, with its lines broken anew as well.
    """
    own: list[str] = []
    quoted: list[tuple[int, int]] = []
    run: list[str] = []
    level = 0

    def close():
        paragraphs = re.split(r"\n[ \t]*\n", "\n".join(run))
        pieces = {normal(x) for x in ["\n".join(run), *paragraphs, *run]} - {b""}
        quoted.extend((level, xxhash.xxh64_intdigest(x)) for x in sorted(pieces))
        run.clear()

    for line in text.split("\n"):
        m = MARKS.match(line)
        depth = m[1].count(">") if m else 0
        if depth != level:
            if level:
                close()
            elif own and depth and LEAD_IN.search(own[-1].rstrip(" \t")):
                own.pop()
            level = depth
        (run if depth else own).append(line[m.end() :] if m else line)
    if level:
        close()
    body = "\n".join(own).strip("\n")
    pieces = {normal(x) for x in [*re.split(r"\n[ \t]*\n", body), *own, body]} - {b""}
    return body, quoted, sorted(xxhash.xxh64_intdigest(x) for x in pieces)


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without quotes in reply order: conv_id, position, turn, role, text, reply_to, thread, n_quotes, n_linked.

    reply_to is the turn that the message quotes: of the earlier turns of its
    conversation that wrote a passage it quotes at its lowest linked level,
    the latest. thread is the first turn of the chain of replies, the own turn
    where nothing is quoted. position counts from 0 in each conversation by
    thread, then turn, then role and text. n_linked counts the quoted passages
    that were found.

    A null text is empty; messages with a null turn come first and neither
    link nor are linked to; null conversation ids are one conversation without
    links; of repeated rows each is kept; an empty table gives no rows.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t or "") for t in batch.column(3).to_pylist()]
            quotes = [[{"level": a, "h": h - (1 << 64) if h >> 63 else h} for a, h in q] for _, q, _ in found]
            wrote = [[h - (1 << 64) if h >> 63 else h for h in w] for _, _, w in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([b for b, _, _ in found], pa.string()), pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64())]))), pa.array(wrote, pa.list_(pa.int64()))],
                ["conv_id", "turn", "role", "text", "quotes", "wrote"],
            )

    picked = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in picked.schema}
    parsed = cut(picked.mapInArrow(split, ", ".join(f"{c} {types[c]}" for c in picked.columns) + ", quotes array<struct<level: int, h: long>>, wrote array<long>").withColumn("tie", F.monotonically_increasing_id()))
    linked = _latest_before(
        parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.h").where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct(),
        parsed.select("conv_id", "turn", F.explode("wrote").alias("h")).where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct(),
    )
    links = cut(linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("to")).alias("to"))).alias("best"), F.count("*").alias("n_linked")).select("conv_id", "turn", (-F.col("best.to")).alias("reply_to"), "n_linked"))
    threads = links.join(_threads(links), ["conv_id", "turn"])
    full = parsed.join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "tie", "reply_to", F.coalesce("root", "turn").alias("thread"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("thread").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    # all columns of the order part the ranges, so a conversation, a turn of it, even rows that are equal may be in several
    ranged = cut(full.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    counted = ranged.groupBy(F.col("conv_id").alias("c"), part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("c", F.col("part").alias("p"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(counted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("at", 33) == F.col("p"))).select(
        "conv_id", (F.col("at") + F.col("shift")).alias("position"), "turn", "role", "text", "reply_to", "thread", "n_quotes", "n_linked"
    )


def _latest_before(asks: DataFrame, wrote: DataFrame) -> DataFrame:
    """``asks`` (conv_id, turn, level, h) with ``to``, the last turn before theirs that wrote h in their conversation; those without are left out."""
    wanted = wrote.join(asks.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    bucket = F.floor(F.col("turn") / TURNS).alias("bucket")
    last = wanted.groupBy("conv_id", "h", bucket).agg(F.max("turn").alias("last"))
    # of each bucket that is asked from, the last turn of the buckets before
    both = last.select("conv_id", "h", "bucket", "last").unionByName(asks.select("conv_id", "h", bucket).distinct().withColumn("last", F.lit(None).cast("long")))
    buckets = both.groupBy("conv_id", "h", "bucket").agg(F.max("last").alias("last"))
    before = Window.partitionBy("conv_id", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("conv_id", "h", "bucket", F.max("last").over(before).alias("to"))
    rows = (
        carried.select("conv_id", "h", "bucket", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("int").alias("level"), "to")
        .unionByName(asks.select("conv_id", "h", bucket, "turn", "level", F.lit(None).cast("long").alias("to")))
        .unionByName(wanted.select("conv_id", "h", bucket, "turn", F.lit(None).cast("int").alias("level"), F.col("turn").alias("to")))
    )
    # what is carried first; of one turn the quotes before the passages
    run = Window.partitionBy("conv_id", "h", "bucket").orderBy(F.col("turn").asc_nulls_first(), F.col("level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("to", F.last("to", ignorenulls=True).over(run)).where("level IS NOT NULL AND to IS NOT NULL")


def _threads(links: DataFrame) -> DataFrame:
    """The first turn of every linked message's chain, by doubling: as many rounds as the chain's length has bits."""
    now = links.select("conv_id", "turn", F.col("reply_to").alias("root"))
    while True:
        further = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("beyond"))
        stepped = now.join(further, ["conv_id", "root"], "left")
        if stepped.where("beyond IS NOT NULL").isEmpty():
            return now
        now = cut(stepped.select("conv_id", "turn", F.coalesce("beyond", "root").alias("root")))

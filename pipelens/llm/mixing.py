"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target in words and a weight schedule over t in [0, 1]. The
schedule, integrated, says how many of its words are demanded by t; inverting
that gives every document copy the t at which it is read, one t for all
sources, and the copies are range-sorted by t. The demands of all sources added
up turn t into training progress, the share of all words read by then. Order
within a source is by the MD5 of the document's id, so reruns and other
partitionings agree. Words are counted once, in a table without texts, from
which all decisions follow; running sums are taken in two steps, within buckets
of that hash and over the buckets, so that a source with a third of all rows is
not one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import WORD, cut

#: Most copies of one document in a mix.
MOST = 3
#: Relative density at t = 0 and t = 1 of sources that weigh 1, 2 and 3: light ones early, heavy ones late.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Passes in hash order over what is left of the targets, before the smallest documents go first.
PASSES = 3


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size and any others) with the weights and targets of the sources.

    Sources by code point, null last, weigh 1, 2, 3, 1 and so on. Together
    they share the sum of all sizes by weight; no target exceeds ``MOST``
    times its source's size and the excess goes to the others by weight. That
    fixed point is ``min(MOST * size, level * weight)`` for one level, which
    running sums over the sources find without iteration.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    level = (F.col("total") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before"))
    return (
        ranked.withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(all_rows))
        .withColumn("capped_before", F.coalesce(F.sum(MOST * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", level)
        # the first source, by ratio, that the level of what is left does not exceed
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level").alias("v")))).over(all_rows))
        .withColumn("target", F.least(MOST * F.col("source_size").cast("double"), F.coalesce(F.col("final.v") * F.col("weight"), MOST * F.col("source_size").cast("double"))))
        .select(*sizes.columns, "weight", "target")
    )


def position_of(demand: Column, target: Column, start: Column, end: Column) -> Column:
    """The t at which a linear density from ``start`` to ``end`` has demanded ``demand`` of ``target`` words."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), demand / target))
    area = share * (start + end) / 2
    slope = end - start
    return F.when(slope == 0, share).otherwise((F.sqrt(start * start + 2 * slope * area) - start) / slope)


def progress_of(t: Column, totals: dict[int, float], schedule=SCHEDULE) -> Column:
    """The share of all words that the sources together have demanded by t; ``totals`` has the targets by weight."""
    words = F.lit(0.0)
    for weight, (a, b) in enumerate(schedule, 1):
        words = words + F.lit(totals.get(weight, 0.0)) * ((F.lit(float(a)) * t + F.lit(float(b) - float(a)) * t * t / F.lit(2.0)) / F.lit((float(a) + float(b)) / 2))
    return words / F.lit(sum(totals.get(w, 0.0) for w in range(1, len(schedule) + 1)) or 1.0)


def _base(docs: DataFrame, id_col: str, source: str, text: str, row: bool) -> DataFrame:
    """What the mix needs of every document, and with ``row`` the document itself, as one column so that no name can clash."""
    return docs.select(
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if row else []),
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
        # never null, so that joins and windows by it share one partitioning
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("group"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64(text).alias("tie"),
    )


ORDER = ("key", "doc_id", "size", "tie")


class Plan:
    """The sources' targets and the words before each bucket of a source, from documents without their texts."""

    def __init__(self, slim: DataFrame, schedule):
        self.schedule = schedule
        sizes = slim.groupBy("group", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        plan = targets(sizes).select(
            "group", "source_size", "weight", "target",
            F.ceil(F.sqrt("n")).alias("buckets"),  # as many buckets as a bucket has documents, about
            F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long").alias("whole"),
        )
        self.plan = cut(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
        # whether there are few enough sources to broadcast what is known of them: it is counted, up to the bound
        self.few = self.plan.limit(10_001).count() <= 10_000
        # in decimals, so that the sum is the same in any order
        self.totals = {r[0]: float(r[1]) for r in self.plan.groupBy("weight").agg(F.sum(F.col("target").cast("decimal(38,6)"))).collect()}
        self.slim = self.running(slim, self.before(slim, F.col("size")))

    def small(self, sources: DataFrame) -> DataFrame:
        return F.broadcast(sources) if self.few else sources

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's plan and their bucket, by the hash."""
        there = rows.join(self.small(self.plan), "group")
        return there.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32)).cast("int"))

    def before(self, rows: DataFrame, words: Column) -> DataFrame:
        """(group, bucket, before): the words of the buckets of a source before each."""
        sums = (rows if "bucket" in rows.columns else self.placed(rows)).groupBy("group", "bucket").agg(F.sum(words).alias("words"))
        return sums.select("group", "bucket", (F.sum("words").over(Window.partitionBy("group").orderBy("bucket")) - F.col("words")).alias("before"))

    def running(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        """Rows with ``end``, the running sum of sizes in hash order, and ``extra``, whether one copy more fits in order."""
        order = Window.partitionBy("group", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        summed = self.placed(rows).withColumn("end", F.sum("size").over(order)).join(before, ["group", "bucket"])
        summed = summed.withColumn("end", F.col("end") + F.col("before")).drop("before")
        free = (F.col("whole") < MOST) & (F.col("size") > 0)
        return summed.withColumn("free", free).withColumn("extra", (free & (F.col("end") <= F.col("rest"))).cast("long"))


def assign(docs: DataFrame, schedule=SCHEDULE, id_col: str = "doc_id", source: str = "source", text: str = "text", refill: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, copies, taken and its copies' places in the mix.

    A null text has size 0; nulls of ``source`` are one source. Every document
    is taken ``floor(target / source_size)`` times; one more time, in hash
    order, as long as whole documents fit in what is left of the target; and
    the gap that then remains goes to the untaken document nearest to it in
    size, if that brings the source nearer. With ``refill`` documents that do
    not fit are passed over before that, until no untaken document fits the
    gap (``_refilled``). ``positions`` are the t of the schedule at which the
    copies are read, ascending, ``position`` is the first of them (null if
    none is taken) and ``progress`` the share of all words read by then.
    Repeated rows count as documents of their own; an empty table gives no rows.
    """
    plan = Plan(cut(_base(docs, id_col, source, text, False)), schedule)
    rows = (_refilled if refill else _filled)(plan, plan.slim)
    return rows.select("doc_id", "source", "size", "source_size", "weight", "target", "copies", "taken", "position", "positions", progress_of(F.col("position"), plan.totals, schedule).alias("progress"))


def _refilled(plan: Plan, rows: DataFrame) -> DataFrame:
    """``rows`` with more documents taken until none that is left fits its source's gap, and the one that then brings it nearest.

    A pass goes on in hash order over the untaken documents that fit the gap
    alone, as long as their running sum fits. After ``PASSES`` of them the
    smallest are taken, whole sizes first and then, in hash order, what fits
    of the next size. What a pass takes is named by two numbers for each
    source, a greatest size and a last running sum, so documents are only
    marked by a join with the sources. ``rows`` may carry the documents.
    """
    held = cut(plan.slim.select("group", "bucket", "size", "end", "extra", "rest", "free"))
    state = cut(held.groupBy("group").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("extra") == 1, F.col("end"))), F.lit(0))).alias("gap")))
    untaken = held.where("free AND extra = 0").select("group", "bucket", "size", "end")
    everything = F.lit((1 << 63) - 1)
    picks: list[DataFrame] = []

    def took(limits: DataFrame) -> None:
        """Note what a pass took, rows (group, most, last, words), and lower the gaps."""
        nonlocal state, untaken
        limits = cut(limits)
        picks.append(limits.select("group", F.struct("most", "last").alias("pick")))
        state = cut(state.join(limits, "group", "left").select("group", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap")))
        there = untaken.join(plan.small(limits), "group", "left")
        untaken = there.where(F.coalesce((F.col("size") > F.col("most")) | (F.col("end") > F.col("last")), F.lit(True))).select("group", "bucket", "size", "end")

    def in_order(most: DataFrame) -> DataFrame:
        """What fits of the documents up to a size, in hash order; ``most`` has rows (group, gap, most)."""
        fits = untaken.join(plan.small(most), "group").where("size <= most")
        order = Window.partitionBy("group", "bucket").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
        run = fits.withColumn("run", F.sum("size").over(order)).join(plan.before(fits, F.col("size")), ["group", "bucket"])
        run = run.withColumn("run", F.col("run") + F.col("before")).where("run <= gap")
        return run.groupBy("group").agg(F.first("most").alias("most"), F.max("end").alias("last"), F.max("run").alias("words"))

    for _ in range(PASSES):
        took(in_order(state.select("group", "gap", F.col("gap").alias("most"))))
    by_size = untaken.groupBy("group", "size").agg(F.sum("size").alias("words")).withColumn("run", F.sum("words").over(Window.partitionBy("group").orderBy("size")))
    by_size = cut(by_size.join(state, "group").select("group", "gap", "size", "run"))
    took(by_size.where("run <= gap").groupBy("group").agg(F.max("size").cast("double").alias("most"), F.max("run").alias("words")).select("group", "most", everything.alias("last"), "words"))
    smallest = by_size.where("run > gap").groupBy("group").agg(F.min("size").cast("double").alias("most"))
    took(in_order(state.join(smallest, "group").select("group", "gap", "most")))

    marks = state.join(_nearest(plan, untaken, state), "group", "left")
    for i, x in enumerate(picks):
        marks = marks.join(x.withColumnRenamed("pick", f"pick_{i}"), "group", "left")
    marks = cut(marks.select("group", "only", F.array_compact(F.array(*(f"pick_{i}" for i in range(len(picks))))).alias("picks")))

    def marked(some: DataFrame) -> DataFrame:
        more = F.exists("picks", lambda x: (F.col("size") <= x["most"]) & (F.col("end") <= x["last"])) | F.coalesce(F.col("end") == F.col("only"), F.lit(False))
        return some.join(plan.small(marks), "group").withColumn("extra", F.greatest("extra", (more & F.col("free")).cast("long"))).drop("only", "picks")

    # the extra copies are dealt in hash order, so they have running sums of their own; equal rows in the order of their first ones
    order = Window.partitionBy("group", "bucket").orderBy(*ORDER, "end").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut(plan.before(marked(held), F.col("size") * F.col("extra")))
    done = marked(rows).withColumn("run", F.sum(F.col("size") * F.col("extra")).over(order)).join(sums, ["group", "bucket"])
    return _finished(done.withColumn("run", F.col("run") + F.col("before")).drop("before"), plan)


def _nearest(plan: Plan, untaken: DataFrame, gaps: DataFrame) -> DataFrame:
    """(group, only): the running sum that names the untaken document nearest in size to its source's gap, if it brings the source nearer."""
    near = F.abs(F.col("size") - F.col("gap"))
    found = untaken.join(plan.small(gaps), "group").where(near < F.col("gap"))
    # the running sum of a document with words is different from all others of its source, and ascends with the hash
    return found.groupBy("group").agg(F.min(F.struct(near.alias("near"), "end")).alias("f")).select("group", F.col("f.end").alias("only"))


def _filled(plan: Plan, rows: DataFrame) -> DataFrame:
    """Give each source's gap to the untaken document nearest in size, one row of it."""
    held = cut(plan.slim.select("group", "size", "end", "extra", "rest", "free"))
    gaps = held.groupBy("group").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("extra") == 1, F.col("end"))), F.lit(0))).alias("gap"))
    only = cut(gaps.join(_nearest(plan, held.where("free AND extra = 0"), gaps), "group", "left").select("group", "only"))
    more = F.coalesce((F.col("end") == F.col("only")) & F.col("free"), F.lit(False))
    done = rows.join(plan.small(only), "group").withColumn("extra", F.col("extra") + more.cast("long")).drop("only")
    return _finished(done.withColumn("run", F.col("end")), plan)


def _finished(done: DataFrame, plan: Plan) -> DataFrame:
    """Rows with copies, taken, positions and position."""
    copies = (F.col("whole") + F.col("extra")).cast("long")
    done = done.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    start_w = F.element_at(F.array(*(F.lit(float(a)) for a, _ in plan.schedule)), F.col("weight"))
    end_w = F.element_at(F.array(*(F.lit(float(b)) for _, b in plan.schedule)), F.col("weight"))
    each = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
    # the copy beyond the whole ones has a running sum of its own
    sum_of = lambda copy: F.when((copy == F.col("whole")) & (F.col("extra") > 0), F.col("run")).otherwise(F.col("end"))
    at = F.transform(each, lambda copy: position_of(copy * F.col("source_size") + sum_of(copy) - F.col("size") / 2, F.col("target"), start_w, end_w))
    done = done.withColumn("positions", F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>")))
    return done.withColumn("position", F.get("positions", F.lit(0)))


def mix(docs: DataFrame, schedule=SCHEDULE, position: str | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text", refill: bool = True) -> DataFrame:
    """The mix itself: every copy as a row of the columns of ``docs``, range-sorted by training position.

    ``position`` names a column to add with that position. Documents that the
    mix does not take are left out, so those without words are. Targets are
    filled (``refill``). Nulls, repeated rows and empty tables are as in
    ``assign``; the texts are moved twice, by bucket and by position.
    """
    plan = Plan(cut(_base(docs, id_col, source, text, False)), schedule)
    base = _base(docs, id_col, source, text, True)
    rows = (_refilled if refill else _filled)(plan, plan.running(base, cut(plan.before(plan.slim, F.col("size")))))
    out = rows.where("copies > 0").select("row", "doc_id", "tie", F.explode("positions").alias("at"))
    out = out.repartitionByRange("at", "doc_id", "tie").sortWithinPartitions("at", "doc_id", "tie")
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns), *([F.col("at").alias(position)] if position else []))

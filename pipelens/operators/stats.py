"""Duration distributions, histograms and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duration_distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact min, upper median, p95 and max of ``value`` for each ``key``.

    The median is the element at ``n div 2`` (no interpolation) and p95 the
    one at ``floor(0.95 n)``, both from 0. Values are first counted per
    (key, value), so a hot key sends one row for each different value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    by_value = Window.partitionBy(key).orderBy(value)
    ranked = counted.withColumn("hi", F.sum("c").over(by_value)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = lambda index: F.max(F.when((F.col("hi") - F.col("c") <= index) & (index < F.col("hi")), F.col(value)))
    half = F.floor(F.col("n") / 2)
    p95 = F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1)
    return ranked.groupBy(key).agg(
        F.sum("c").alias("n"),
        F.min(value).alias("min_value"),
        at(half).alias("median_value"),
        at(p95).alias("p95_value"),
        F.max(value).alias("max_value"),
    )


#: Upper bounds of the launch-latency histogram, in milliseconds.
LATENCY_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def histogram(df: DataFrame, value: str, bounds=LATENCY_BOUNDS) -> DataFrame:
    """(le, n, cumulative): observations by the first bound they do not exceed; null ``le`` is the open end.

    Empty buckets are there too.
    """
    bucket = F.lit(None).cast("double")
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(bucket)
    counted = df.where(F.col(value).isNotNull()).groupBy(bucket.alias("le")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(float(b),) for b in bounds] + [(None,)], "le double")
    filled = every.join(counted.withColumnRenamed("le", "c_le"), F.col("le").eqNullSafe(F.col("c_le")), "left").select("le", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # one row for each bound
    return filled.withColumn("cumulative", F.sum("n").over(Window.orderBy(F.col("le").asc_nulls_last())))


def histogram_totals(df: DataFrame, value: str) -> DataFrame:
    """(observations, sum): each observation counts with its whole part."""
    return df.agg(F.count(value).alias("observations"), F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0)).alias("sum"))


def prometheus_lines(hist: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Bucket lines of the text exposition, cumulative, the open end last; ``keep`` names columns that stay beside them."""
    bound = F.when(F.col("le").isNull(), "+Inf").when(F.col("le") == F.floor("le"), F.col("le").cast("long").cast("string")).otherwise(F.col("le").cast("string"))
    return hist.select(*(keep or []), F.concat(F.lit(f'{name}_bucket{{le="'), bound, F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))


def exposition(counters: DataFrame, hist: DataFrame, totals: DataFrame, name: str, about: str) -> DataFrame:
    """(block, at, line): the whole text exposition, in the order of block and at.

    ``counters`` has name, about, kind (counter or gauge) and value, a block
    each in the order of names; the histogram with its sum and count comes last.
    """
    own = F.concat(F.lit(" "), "name", F.lit(" "))
    lines = F.array(F.concat(F.lit("# HELP"), own, F.col("about")), F.concat(F.lit("# TYPE"), own, F.col("kind")), F.concat("name", F.lit(" "), F.col("value").cast("string")))
    first = counters.select(F.col("name").alias("block"), F.posexplode(lines).alias("at", "line"))
    last = F.lit("\U0010ffff").alias("block")
    head = hist.sparkSession.createDataFrame([(0, f"# HELP {name} {about}"), (1, f"# TYPE {name} histogram")], "at int, line string")
    buckets = prometheus_lines(hist, name, ["le"]).select(last, (F.row_number().over(Window.orderBy(F.col("le").asc_nulls_last())) + 1).alias("at"), "line")
    ends = F.array(F.concat(F.lit(f"{name}_count "), F.col("observations").cast("string")), F.concat(F.lit(f"{name}_sum "), F.col("sum").cast("string")))
    tail = totals.select(last, F.posexplode(ends).alias("at", "line")).withColumn("at", F.col("at") + 1_000_000)
    return first.union(head.select(last, "at", "line")).union(buckets).union(tail)


def tally(results: DataFrame, passed: str = "passed", key: str | None = None) -> DataFrame:
    """(n_passed, n_failed, status) of a suite's scenarios; a null result failed, and a suite without scenarios passes."""
    good = F.coalesce(F.col(passed), F.lit(False))
    out = results.groupBy(*([key] if key else [])).agg(F.count_if(good).alias("n_passed"), F.count_if(~good).alias("n_failed"))
    return out.withColumn("status", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL"))


def pipeline_summary(runs: DataFrame, key: str | None = None) -> DataFrame:
    """Counts by status, time saved by cached runs and its share of what a run without cache would take.

    ``runs`` has status, duration_ms and original_ms; early cutoffs count
    where a boolean column early_cutoff is true.
    """
    saved = F.coalesce(F.sum(F.when(F.col("status") == "CACHED", F.greatest(F.lit(0), F.col("original_ms") - F.col("duration_ms")))), F.lit(0)).cast("long")
    out = runs.groupBy(*([key] if key else [])).agg(
        F.count("*").alias("n_tasks"),
        F.count_if(F.col("status") == "EXECUTED").alias("n_executed"),
        F.count_if(F.col("status") == "CACHED").alias("n_cached"),
        F.count_if(F.col("status") == "FAILED").alias("n_failed"),
        F.count_if(F.col("early_cutoff")).alias("n_early_cutoff"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_ms"),
        saved.alias("saved_ms"),
    )
    whole = F.col("total_ms") + F.col("saved_ms")
    return out.withColumn("saved_percent", F.when(whole > 0, F.col("saved_ms") * F.lit(100.0) / whole).otherwise(0.0))


def task_stats(runs: DataFrame, task: str, duration: str, at: str, tie: str) -> DataFrame:
    """(task, last_duration, n_runs, last_executed): the latest run by time, then by ``tie``."""
    order = F.struct(at, tie)
    return runs.groupBy(F.col(task).alias("task")).agg(
        F.max_by(duration, order).alias("last_duration"),
        F.count("*").alias("n_runs"),
        F.max_by(F.when(F.col("status") != "CACHED", F.col(duration)), F.when(F.col("status") != "CACHED", order)).alias("last_executed"),
    )


def speed_up(runs: DataFrame, duration: str = "duration_ms") -> DataFrame:
    """(skip_percent, speed_up): share of cached runs, and mean executed over mean cached duration."""
    n = F.count("*")
    executed, cached = (F.avg(F.when(F.col("status") == s, F.col(duration))) for s in ("EXECUTED", "CACHED"))
    return runs.agg(
        F.when(n > 0, F.count_if(F.col("status") == "CACHED") * F.lit(100.0) / n).otherwise(0.0).alias("skip_percent"),
        F.when(cached > 0, executed / cached).otherwise(0.0).alias("speed_up"),
    )


def profile_totals(spans: DataFrame, wall_ms: float, cores: int) -> DataFrame:
    """(user_ms, sys_ms, max_mem_kb, utilisation): CPU over wall time in percent, at most all cores."""
    cpu = F.col("user_ms") + F.col("sys_ms")
    return spans.agg(F.sum("user_ms").alias("user_ms"), F.sum("sys_ms").alias("sys_ms"), F.max("mem_kb").alias("max_mem_kb")).withColumn(
        "utilisation", F.least(cpu / F.lit(max(wall_ms, 0.1)) * 100.0, F.lit(cores * 100.0))
    )


def flame_geometry(spans: DataFrame, width: float = 1000.0, row: int = 24) -> DataFrame:
    """Rectangles of a flame graph: x and w in shares of the whole span, y by batch. ``span_order`` numbers them."""
    ends = spans.agg(F.min("start_us").alias("t0"), F.max(F.col("start_us") + F.col("dur_us")).alias("t1"))
    scale = F.lit(width) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    # the one row of ends is its whole table
    return spans.join(F.broadcast(ends)).select(
        "name", "batch", ((F.col("start_us") - F.col("t0")) * scale).alias("x"), (F.col("batch") * row).cast("long").alias("y"), F.greatest(F.col("dur_us") * scale, F.lit(1.0)).alias("w")
    )


def span_order(spans: DataFrame) -> DataFrame:
    """``spans`` with ``position`` from 1 in each batch, by start, then name."""
    return spans.withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("start_us", "name")).cast("long"))


def chrome_trace(spans: DataFrame) -> DataFrame:
    """A complete event of the trace format as JSON for each span."""
    event = F.struct(F.col("name"), F.lit("X").alias("ph"), F.col("start_us").alias("ts"), F.col("dur_us").alias("dur"), F.lit(1).alias("pid"), F.col("batch").alias("tid"), F.struct(F.col("status")).alias("args"))
    return spans.select("name", F.to_json(event).alias("event"))


def aging_order(ready: DataFrame, limit: int | None = None, boost: float = 0.05) -> DataFrame:
    """Ready tasks, first the largest critical path plus ``boost`` for each second waited.

    The boost grows alike for all, so the order is fixed by cp minus boost
    times the moment of readiness, and the first k are a top-k.
    """
    out = ready.withColumn("priority", F.col("cp") - F.lit(boost) * F.unix_micros("ready_at") / F.lit(1e6))
    ordered = out.orderBy(F.col("priority").desc(), "name")
    return ordered.limit(limit) if limit is not None else ordered


def stratified_quota(df: DataFrame, stratum: str, quotas: dict[str, int], order) -> DataFrame:
    """At most ``quotas[s]`` rows of each stratum, the first by ``order``; a sampling operator."""
    wanted = F.lit(0)
    for s, n in quotas.items():
        wanted = F.when(F.col(stratum) == s, n).otherwise(wanted)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_n") <= wanted).drop("_n")

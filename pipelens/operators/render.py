"""Text of charts and metrics, a line or element a row, so that any size can be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.plans.lineage import cut


def xml_escape(text: Column) -> Column:
    """The five reserved characters as entities, the ampersand first."""
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def flame_elements(geometry: DataFrame, row: int = 24) -> DataFrame:
    """(y, x, element): an SVG rectangle with its title for each row of ``stats.flame_geometry``."""
    box = F.format_string('<g><title>%s</title><rect x="%.2f" y="%d" width="%.2f" height="%d"/></g>', xml_escape(F.col("name")), "x", "y", "w", F.lit(row - 2))
    return geometry.select("y", "x", box.alias("element"))


def dependency_lines(edges: DataFrame) -> DataFrame:
    """(node, line): each task with what it depends on, in byte order, for a terminal."""
    deps = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("deps"))
    roots = edges.select(F.col("src").alias("node")).distinct().join(deps, "node", "left_anti").select("node", F.array().cast("array<string>").alias("deps"))
    both = deps.select("node", F.transform("deps", lambda d: d.cast("string")).alias("deps")).union(roots)
    return both.select("node", F.when(F.size("deps") == 0, F.col("node").cast("string")).otherwise(F.concat(F.col("node").cast("string"), F.lit(" <- "), F.array_join("deps", ", "))).alias("line"))


def otlp_payloads(totals: DataFrame, service: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(export_id, n, payload): metrics exports of at most ``most_bytes`` each, from rows (name, value) and, if wanted, kind.

    Rows of kind ``gauge`` are gauges, all others counters. They are sorted by
    name over all partitions and cut where a running sum of their sizes passes
    the room that the largest leaves; only a row that alone takes more than half
    of the bound can make a payload larger than it. The id is the digest
    of the payload, so what is sent again can be told. No rows, no payloads.
    """
    kind = F.col("kind") if "kind" in totals.columns else F.lit(None).cast("string")
    points = F.struct(F.array(F.struct(F.col("value").cast("string").alias("asInt"))).alias("dataPoints"))
    counter = F.struct(points["dataPoints"].alias("dataPoints"), F.lit(True).alias("isMonotonic"), F.lit(2).alias("aggregationTemporality"))
    gauge = kind == "gauge"
    metric = F.struct(F.col("name"), F.when(~F.coalesce(gauge, F.lit(False)), counter).alias("sum"), F.when(gauge, points).alias("gauge"))
    rows = totals.select("name", F.to_json(metric).alias("point"), (F.octet_length(F.to_json(metric)) + 1).cast("long").alias("size"))
    # which partition a row is in has to outlive a lost executor
    ranged = cut(rows.repartitionByRange("name", "point").withColumn("part", F.spark_partition_id()))
    resource = F.to_json(F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes")))
    begin = F.concat(F.lit('{"resourceMetrics":[{"resource":'), resource, F.lit(',"scopeMetrics":[{"metrics":['))
    end = F.lit("]}]}]}")
    room = ranged.agg(F.greatest(F.lit(1), F.lit(most_bytes) - F.octet_length(F.concat(begin, end)) - F.least(F.max("size"), F.lit(most_bytes // 2))).alias("room"))
    before = F.sum("size").over(Window.partitionBy("part").orderBy("name", "point").rowsBetween(Window.unboundedPreceding, -1))
    # one row
    cells = ranged.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(room)).withColumn("cell", F.floor(F.col("before") / F.col("room")))
    made = cells.groupBy("part", "cell").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "point"))), lambda x: x["point"]), ",").alias("body"))
    return made.select("n", F.concat(begin, "body", end).alias("payload")).select(F.sha2("payload", 256).alias("export_id"), "n", "payload")


def otlp_metrics(totals: DataFrame, service: str) -> DataFrame:
    """(payload): JSON of one metrics export, from rows (name, value) of a few counters; ``otlp_payloads`` takes any number."""
    point = F.struct(F.col("name"), F.struct(F.array(F.struct(F.col("value").cast("string").alias("asInt"))).alias("dataPoints"), F.lit(True).alias("isMonotonic"), F.lit(2).alias("aggregationTemporality")).alias("sum"))
    all_ = totals.agg(F.array_sort(F.collect_list(point)).alias("m"))
    attribute = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value")))
    body = F.struct(F.array(F.struct(F.struct(attribute.alias("attributes")).alias("resource"), F.array(F.struct(F.col("m").alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return all_.select(F.to_json(body).alias("payload"))

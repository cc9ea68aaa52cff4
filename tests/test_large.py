"""What shows only on large tables: joins that must not be broadcast, tokens that collide, sizes and times at the edge."""

import duckdb
from pyspark.sql import functions as F

from pipelens.functions import hashing
from pipelens.operators import blocks, diagnose, env, store
from pipelens.plans import graph


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, path, sql: str):
    """A table whose size is known when a query is planned."""
    spark.sql(sql).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_suggestions_broadcast_no_exploded_names(spark, tmp_path):
    """pieces and deletions of names are many times what is planned from the names."""
    asked = stored(spark, tmp_path / "a", "SELECT explode(array('buidl', 'xlinty')) AS n")
    known = stored(spark, tmp_path / "k", "SELECT explode(array('build', 'lint')) AS n")
    found = graph.suggestions(asked, known)
    assert "BroadcastHashJoin" not in plan_of(found) and plan_of(found).count("SortMergeJoin") >= 3
    assert sorted(map(tuple, found.select(F.col("wanted"), "suggestion").collect())) == [("buidl", "build"), ("xlinty", "lint")]


def test_tokens_that_collide_are_put_back_by_key(spark):
    """two secrets of different keys with one token of eight digits gave two rows for each line."""
    from pipelens.functions.secrets import cloak_token

    i = F.col("id")
    named = spark.range(300_000).select(i.alias("line_no"), F.concat(F.lit("KEY"), i).alias("key"), F.concat(F.lit("value"), i, F.lit("-0123456")).alias("v"))
    twice = named.withColumn("t", cloak_token(F.col("key"), F.col("v"))).groupBy("t").agg(F.sort_array(F.collect_list("line_no")).alias("n")).where("size(n) > 1").select(F.explode("n").alias("line_no"))
    some = named.join(twice, "line_no").cache()
    assert some.count() >= 2
    line = lambda value: some.select("line_no", F.concat("key", F.lit("="), value).alias("line"))
    old, new = line(F.col("v")), line(cloak_token(F.col("key"), F.col("v")))
    got = sorted(map(tuple, env.merge(old, new).collect()))
    assert got == sorted((r.line_no, "restored", r.line) for r in old.collect())
    # under a key that has no such token, the last of the values counts
    last = max((r.line_no, r.v) for r in some.collect())
    other = some.where(F.col("line_no") == last[0]).select(F.lit(1).alias("line_no"), F.concat(F.lit("NEW="), cloak_token(F.col("key"), F.col("v"))).alias("line"))
    assert list(map(tuple, env.merge(old, other).collect())) == [(1, "restored", f"NEW={last[1]}")]


def test_sizes_of_a_gigabyte_and_more_in_a_report(spark):
    """a report in KB and MB, as its SQL says, told larger caches in GB."""
    sizes = [(0, "0.0 KB"), (100, "0.1 KB"), (1 << 20, "1.0 MB"), (5 << 18, "1.2 MB"), (7 << 18, "1.8 MB"), (1487008380, "1418.1 MB"), (3 << 40, "3145728.0 MB")]
    df = spark.createDataFrame([(n,) for n, _ in sizes], "n long")
    assert [r.s for r in df.select(hashing.format_bytes(F.col("n"), "KM").alias("s")).collect()] == [s for _, s in sizes]
    assert [r.s for r in df.select(hashing.format_bytes(F.col("n")).alias("s")).collect()][-2:] == ["1.4 GB", "3.0 TB"]
    blobs = spark.createDataFrame([(1487008380,)], "size long")
    message = lambda *units: diagnose.doctor_report(None, blobs, True, "", *units).where("category = 'Cache Storage'").first().message
    assert (message("KM"), message()) == ("1 entries, 1418.1 MB", "1 entries, 1.4 GB")


def test_beacons_of_parts_of_a_second_go_by_the_nearest(spark):
    """F2: at 15.5 seconds ahead a beacon counted as 15 ahead, and at half a second too old not at all."""
    rows = [("a", "n1", 15.4999), ("b", "late", 15.5), ("c", "later", 15.9), ("d", "edge", -60.5), ("e", "old", -60.500001), ("f", "n2", -60.4)]
    df = spark.createDataFrame([(a, n, t, i) for i, (a, n, t) in enumerate(rows)], "addr string, node_id string, t double, seq long").withColumn("ts", F.timestamp_micros((F.lit(200_000_000) + F.round(F.col("t") * 1_000_000)).cast("long")))
    got = {r.addr: r.node_id for r in store.beacon_peers(df, F.timestamp_seconds(F.lit(200))).collect()}
    sql = duckdb.sql("SELECT t FROM (VALUES (15.4999::DOUBLE), (15.5), (15.9), (-60.5), (-60.500001), (-60.4)) v(t) WHERE epoch(make_timestamp((200000000 + t * 1000000)::BIGINT))::BIGINT BETWEEN 140 AND 215").fetchall()
    assert got == {"a": "n1", "d": "edge", "f": "n2"} == {a: n for a, n, t in rows if (t,) in sql}


def sent(spark, run) -> list[str]:
    """Joins by broadcast in the final plans of what ``run`` executes."""
    seen = spark._jsparkSession.sharedState().statusStore()
    n = seen.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [seen.executionsList(n, 1000).apply(i).physicalPlanDescription() for i in range(seen.executionsList(n, 1000).size())]
    return [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_rounds_over_graphs_broadcast_nothing(spark, tmp_path):
    """sizes planned from columns and checkpoints made each round send whole levels to the driver."""
    tasks = stored(spark, tmp_path / "t", "SELECT id AS node, id * 10 AS duration FROM range(1, 16)")
    edges = tasks.where("node > 1").select(F.floor(F.col("node") / 2).alias("src"), F.col("node").alias("dst"))

    def run():
        made = graph.batches(graph.levels(tasks.select("node"), edges), graph.critical_paths(tasks, edges)).collect()
        assert {r.node: r.level for r in made} == {k: k.bit_length() - 1 for k in range(1, 16)}
        assert [r.node for r in made if r.level == 1 and r.position == 1] == [3]

    assert sent(spark, run) == []
    from pipelens.table_queries import incremental_tokens

    tasks.select(F.col("node").alias("p_partkey"), F.concat(F.lit("p"), "node").alias("p_name"), F.lit("x").alias("p_type"), (F.col("node") % 5).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    assert sent(spark, lambda: incremental_tokens(spark, str(tmp_path)).collect()) == []


def test_parts_of_file_differences_follow_the_input(spark, monkeypatch):
    """contents met in as many parts as the session names, however many bytes there were."""
    monkeypatch.setattr(blocks, "TASK_BYTES", 1000)
    rows = spark.range(40).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("a"), 500).alias("content"))
    other = rows.withColumn("content", F.when(F.col("path") == "7", F.concat(F.repeat(F.lit("a"), 300), F.repeat(F.lit("b"), 200))).otherwise(F.col("content")))
    found = blocks.value_differences(rows, other, block=64, fanout=4)
    assert "REPARTITION_BY_NUM" in plan_of(found) and "hashpartitioning(path" in plan_of(found) and f", {-(-80 * 8 * 64 // 1000)})" in plan_of(found).replace(", REPARTITION_BY_NUM", ")")
    assert {r.path: r.offset for r in found.collect() if r.offset != -1} == {"7": 300}

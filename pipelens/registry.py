"""Registered queries with, where SQL can say the same, their DuckDB text.

Every query is a function of ``(spark, sf_dir)`` that reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Operators on a few fixed rows, with SQL: for the tests, not registered as queries, as they read no table.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXAMPLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function under ``name`` with its oracle text."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return put


def example(name: str, sql: str):
    """Keep a function of fixed rows under ``name`` with the SQL that says the same."""

    def put(f):
        EXAMPLES[name], EXAMPLE_SQL[name] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DISTRIBUTION = """
SELECT {task} AS task, count(*) AS n,
       min({v}) AS min_value,
       max(CASE WHEN rn = {half} + 1 THEN {v} END) AS median_value,
       max(CASE WHEN rn = least(CAST(floor(n_all * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1, n_all) THEN {v} END) AS p95_value,
       max({v}) AS max_value
FROM (SELECT {task}, {v}, row_number() OVER (PARTITION BY {task} ORDER BY {v}) AS rn,
             count(*) OVER (PARTITION BY {task}) AS n_all FROM events) t
GROUP BY {task}
"""


@query("task_duration_distribution", _DISTRIBUTION.format(task="event_type", v="value", half="n_all // 2"))
def task_duration_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipelens.operators.stats import duration_distribution

    return duration_distribution(table(spark, sf_dir, "events"), "event_type", "value").withColumnRenamed("event_type", "task")

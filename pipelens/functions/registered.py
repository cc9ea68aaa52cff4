"""Functions for SQL: expressions as SQL functions, which stay in the JVM, and the few that need Python."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: name: (parameters, result, expression).
EXPRESSIONS = {
    "mask_secret": ("v STRING", "STRING", "CASE WHEN octet_length(trim(v)) <= 6 THEN '******' ELSE concat(left(trim(v), 3), '...', right(trim(v), 3)) END"),
    "merkle_digest": ("m MAP<STRING, STRING>", "STRING", "CASE WHEN coalesce(size(m), 0) <= 0 THEN '' ELSE sha2(array_join(transform(array_sort(map_entries(m)), e -> concat(e.key, ':', e.value, '\\n')), ''), 256) END"),
    "shard_path": ("digest STRING", "STRING", "concat(left(digest, 2), '/', substring(digest, 3))"),
    "is_digest": ("digest STRING", "BOOLEAN", "length(digest) = 64 AND NOT digest RLIKE '[./\\\\\\\\]'"),
    "base_name": ("path STRING", "STRING", "element_at(split(path, '/'), -1)"),
}


class EnvLines:
    """(line_no, key, value) of the entries of an environment file's text; comments and blank lines are left out."""

    def eval(self, text: str):
        for n, line in enumerate((text or "").split("\n"), 1):
            clean = line.strip(" \t\r\n\x0b\x0c")
            if not clean or clean.startswith("#"):
                continue
            key, _, value = line.partition("=")
            value = value.strip(" \t\r\n\x0b\x0c")
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            yield n, key.strip(" \t\r\n\x0b\x0c"), value


def register(spark: SparkSession) -> None:
    """Make all of them known to the session's SQL."""
    for name, (parameters, result, expression) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    spark.udtf.register("env_lines", udtf(EnvLines, returnType="line_no int, key string, value string"))

"""Sources: task definitions, file inventories, archives, environment and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK = T.StructType(
    [
        T.StructField("command", T.StringType()), T.StructField("inputs", T.ArrayType(T.StringType())), T.StructField("outputs", T.ArrayType(T.StringType())),
        T.StructField("depends_on", T.ArrayType(T.StringType())), T.StructField("env_vars", T.ArrayType(T.StringType())), T.StructField("cwd", T.StringType()),
        T.StructField("timeout", T.StringType()), T.StructField("retries", T.IntegerType()), T.StructField("weight", T.IntegerType()), T.StructField("shell", T.StringType()),
        T.StructField("clean_output", T.BooleanType()), T.StructField("pure", T.BooleanType()),
    ]
)
CONFIG = T.StructType([T.StructField("default", T.StringType()), T.StructField("workspaces", T.ArrayType(T.StringType())), T.StructField("tasks", T.MapType(T.StringType(), TASK))])


def tasks_json(spark: SparkSession, path: str, package: str = "") -> DataFrame:
    """One row for each task of a definition file; with ``package`` names and bare dependencies are scoped by it.

    Weights below 1 are 1; pure defaults to whether there are outputs. Files
    that are not JSON have no tasks.
    """
    raw = spark.read.schema(CONFIG).json(path, multiLine=True)
    scoped = lambda c: F.when(c.contains("#"), c).otherwise(F.concat(F.lit(package + "#"), c)) if package else c
    array = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rows = raw.select(F.explode("tasks").alias("name", "t"))
    return rows.select(
        scoped(F.col("name")).alias("name"), F.lit(package).alias("package"), F.coalesce("t.command", F.lit("")).alias("command"),
        array(F.col("t.inputs")).alias("inputs"), array(F.col("t.outputs")).alias("outputs"), F.transform(array(F.col("t.depends_on")), scoped).alias("depends_on"),
        array(F.col("t.env_vars")).alias("env_vars"), F.coalesce(F.nullif("t.cwd", F.lit("")), F.lit(package)).alias("cwd"), F.col("t.timeout").alias("timeout"), F.coalesce("t.retries", F.lit(0)).alias("retries"),
        F.greatest(F.coalesce("t.weight", F.lit(1)), F.lit(1)).alias("weight"), F.coalesce("t.shell", F.lit("")).alias("shell"), F.coalesce("t.clean_output", F.lit(False)).alias("clean_output"),
        F.coalesce("t.pure", F.size(array(F.col("t.outputs"))) > 0).alias("pure"),
    )


def workspace(spark: SparkSession, root: str, packages: dict[str, str]) -> DataFrame:
    """The tasks of a root definition and of packages (name to folder), in one table."""
    out = tasks_json(spark, f"{root}/tasks.json")
    for name, folder in sorted(packages.items()):
        out = out.unionByName(tasks_json(spark, f"{root}/{folder}/tasks.json", name))
    return out


def file_stat(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def file_digests(spark: SparkSession, root: str, most_bytes: int = 10 << 20) -> DataFrame:
    """(path, size, mtime, sha256); files of ``most_bytes`` or more have no digest and are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") < most_bytes)
    small = files.select(_relative(root).alias("path"), F.sha2("content", 256).alias("sha256"))
    return file_stat(spark, root).join(small, "path", "left")


def _relative(root: str):
    head = r"^[a-z0-9]+:/+" if ":/" not in root else r"^$"
    plain = F.regexp_replace("path", head, "/")
    return F.regexp_replace(F.substring_index(plain, root.rstrip("/").split("/")[-1] + "/", -1), "^/", "")


def incremental_digests(now: DataFrame, known: DataFrame) -> DataFrame:
    """(path, sha256 or null, fresh): a stored digest holds while size and mtime are the same; the rest must be read."""
    k = known.select("path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), "sha256")
    same = (F.col("size") == F.col("k_size")) & (F.col("mtime") == F.col("k_mtime"))
    return now.join(k, "path", "left").select("path", "size", "mtime", F.when(same, F.col("sha256")).alias("sha256"), F.coalesce(same, F.lit(False)).alias("fresh"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_map(spark: SparkSession, path: str, value: str = "struct<last_duration_ms: long, exec_count: int>") -> DataFrame:
    """(key, value) of a JSON object of records, such as stored task statistics."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples, one JSON object a line."""
    return spark.read.schema("task string, language string, error_type string, prompt string, id string").json(path)


def changed_paths(listing: DataFrame, column: str = "value") -> DataFrame:
    """(path) from the text of a version-control listing: trimmed, non-empty lines."""
    return listing.select(F.explode(F.split(column, "\n")).alias("path")).select(F.trim("path").alias("path")).where("path <> ''").distinct()


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, size, sha256) of the files in tar archives that can be read whole, as ``archives.read_archives`` gives them."""
    from pipelens.sources.archives import read_archives

    return read_archives(spark, path).where("path IS NOT NULL AND error IS NULL").drop("error")


def write_records(records: DataFrame, path: str) -> None:
    """Append records; the committer makes them appear at once or not at all."""
    records.write.mode("append").parquet(path)


def latest(records: DataFrame, key: str, at: str) -> DataFrame:
    """The last record of each key of an append-only table."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(key, "_r.*")

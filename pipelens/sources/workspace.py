"""Workspaces as tables of paths: walks, globs, packages, config roots, cache inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.functions import globs
from pipelens.functions.paths import base_name, walked
from pipelens.operators.layout import inventory
from pipelens.sources.config import CONFIG, TASK, file_digests

#: Directories that a scan of the layout leaves out, and files that a store is still writing.
SCAN_IGNORED = (".git", ".taskcache", "node_modules", "vendor", ".idea", ".vscode", "bin", "dist", "build", "__pycache__", ".venv", "venv")
TEMPORARY = (".tmp-", "blob.")


def matched_files(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """(path), distinct and in byte order, of the files that any of the constant patterns fits.

    A pattern without ``*`` or ``?`` names one file; others are walked for, so
    ignored directories count only where the pattern names them. A walk looks
    at all directories for each pattern.
    """
    p, fits = F.col(path), F.lit(False)
    for pattern in patterns:
        clean = clean_path(pattern)
        fits = fits | (walked(p, clean) & globs.matches(p, clean) if "*" in clean or "?" in clean else p == clean)
    return files.where(fits).select(p.alias("path")).distinct().orderBy("path")


def clean_path(path: str) -> str:
    """A relative path with ``/``, without ``.`` and resolvable ``..`` segments."""
    out: list[str] = []
    for s in path.replace("\\", "/").split("/"):
        if s == ".." and out and out[-1] != "..":
            out.pop()
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out) or "."


def scanned(path: Column) -> Column:
    """Whether a scan of the layout reaches a path."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SCAN_IGNORED)))


def scan_workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, sha256, is_root, category, language) of a folder's files; those of 10 MB or more have no digest."""
    return inventory(file_digests(spark, root).where(scanned(F.col("path"))))


def config_roots(starts: DataFrame, files: DataFrame, name: str = "tasks.json", start: str = "start", path: str = "path") -> DataFrame:
    """(start, root, config): of each folder the nearest one upwards that holds a file ``name``; the folder itself where none does.

    The workspace itself is the empty folder. Every folder meets its own
    ancestors only, by an equi-join.
    """
    folder = F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1), "^/", "")
    there = files.where(base_name(F.col(path)) == name).select(folder.alias("root")).distinct()
    own = starts.select(F.col(start).alias("start")).distinct()
    parts = F.filter(F.split("start", "/"), lambda s: s != "")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("root")))
    nearest = own.select("start", F.inline(up)).join(there, "root").groupBy("start").agg(F.max_by("root", "depth").alias("root"))
    found = own.join(nearest, "start", "left").select("start", F.coalesce("root", "start").alias("root"))
    return found.select("start", "root", F.when(F.col("root") == "", F.lit(name)).otherwise(F.concat("root", F.lit("/" + name))).alias("config"))


def packages(files: DataFrame, patterns: list[str], name: str = "tasks.json", path: str = "path") -> DataFrame:
    """(package, folder): folders that a workspace pattern fits, segment by segment, and that hold a file ``name``."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)
    fits = F.lit(False)
    for pattern in patterns:
        fits = fits | globs.segment_match(F.col("folder"), clean_path(pattern))
    held = files.where(base_name(F.col(path)) == name).select(folder.alias("folder")).where(F.col("folder") != "")
    return held.where(fits).select(base_name(F.col("folder")).alias("package"), "folder").distinct()


def workspace_tasks(configs: DataFrame, path: str = "path", text: str = "text", name: str = "tasks.json") -> DataFrame:
    """The tasks of a root definition and of the packages that its ``workspaces`` patterns find, in one table.

    ``configs`` has the definition files with their texts. Tasks of packages
    are named ``package#task``, so are their bare dependencies, and they run in
    their folder unless they say where. Files that are not JSON have no tasks.
    """
    parsed = configs.select(F.col(path).alias("path"), F.from_json(F.col(text), CONFIG).alias("c"))
    root = parsed.where(F.col("path") == name)
    patterns = [p for r in root.select("c.workspaces").collect() for p in r[0] or []]  # of the one root definition
    found = packages(parsed, patterns, name).select("package", "folder")
    own = parsed.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)).join(found, "folder")
    kind = f"map<string,{TASK.simpleString()}>"
    tasks = root.select(F.lit("").alias("package"), F.lit("").alias("folder"), F.explode(F.col("c.tasks").cast(kind)).alias("name", "t"))
    tasks = tasks.unionByName(own.select("package", "folder", F.explode(F.col("c.tasks").cast(kind)).alias("name", "t")))
    scoped = lambda c: F.when((F.col("package") == "") | c.contains("#"), c).otherwise(F.concat("package", F.lit("#"), c))
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return tasks.select(
        F.when(F.col("package") == "", F.col("name")).otherwise(F.concat("package", F.lit("#"), "name")).alias("name"), "package",
        F.coalesce("t.command", F.lit("")).alias("command"), array("t.inputs").alias("inputs"), array("t.outputs").alias("outputs"),
        F.transform(array("t.depends_on"), scoped).alias("depends_on"), F.coalesce(F.nullif("t.cwd", F.lit("")), "folder").alias("cwd"),
        F.greatest(F.coalesce("t.weight", F.lit(1)), F.lit(1)).alias("weight"), F.coalesce("t.pure", F.size(array("t.outputs")) > 0).alias("pure"),
    )


def blob_inventory(files: DataFrame, path: str = "path", temporary: tuple[str, ...] = TEMPORARY) -> DataFrame:
    """(digest, size, mtime, path) of the blobs below a store's objects: names of 64 characters, lower-cased; files still being written are none.

    In folders of two characters a name has the other 62.
    """
    base = base_name(F.col(path))
    shard = F.regexp_extract(path, r"(?:^|/)([^/]{2})/[^/]{62}\z", 1)
    digest = F.when(F.length(base) == 64, base).when((F.length(base) == 62) & (shard != ""), F.concat(shard, base))
    busy = F.lit(False)
    for t in temporary:
        busy = busy | base.startswith(t)
    return files.where(~busy).withColumn("digest", F.lower(digest)).where("digest IS NOT NULL").select("digest", "size", "mtime", path)


def cache_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """(kind, digest) of a cache folder: ``ac`` for records ``<64>.json`` at its top, ``cas`` for blobs below ``cas/objects``, flat or in folders of two characters."""
    record = F.regexp_extract(path, r"^([^/]{64})\.json\z", 1)
    flat = F.regexp_extract(path, r"^cas/objects/([^/]{64})\z", 1)
    sharded = F.regexp_replace(F.regexp_extract(path, r"^cas/objects/([^/]{2}/[^/]{62})\z", 1), "/", "")
    blob = F.coalesce(F.nullif(flat, F.lit("")), F.nullif(sharded, F.lit("")))
    kind = F.when(record != "", F.struct(F.lit("ac").alias("kind"), record.alias("digest"))).when(blob.isNotNull(), F.struct(F.lit("cas").alias("kind"), blob.alias("digest")))
    return files.select(kind.alias("k")).where("k IS NOT NULL").select("k.*")

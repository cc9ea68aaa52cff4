"""Rule ladders: failed builds, project manifests, pipeline definitions, cache health, simple repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.functions.hashing import format_bytes
from pipelens.plans.graph import cycle_members, edges_of, ghosts

#: Adapters in order, the files that show them, and their tasks (name, command, inputs, outputs, dependencies).
ADAPTERS = ("Go", "Node.js", "Rust", "Python", "Makefile")
MANIFESTS = {"Go": ("go.mod",), "Node.js": ("package.json",), "Rust": ("Cargo.toml",), "Python": ("pyproject.toml", "requirements.txt", "setup.py"), "Makefile": ("Makefile", "makefile")}
TASKS = {
    "Go": (("lint", "go vet ./...", ()), ("test", "go test -v ./...", ("lint",)), ("build", "go build -o bin/{module} .", ("test",))),
    "Node.js": (("lint", "npm run lint", ()), ("test", "npm test", ("lint",)), ("build", "npm run build", ("test",))),
    "Rust": (("check", "cargo check", ()), ("test", "cargo test", ("check",)), ("build", "cargo build --release", ("test",))),
    "Python": (("lint", "python -m ruff check .", ()), ("test", "pytest", ("lint",))),
}


def failure(output: Column) -> Column:
    """The kind of a failed build, by the first phrase that its output holds, case ignored."""
    low = F.lower(output)
    return (
        F.when(low.contains("cycle detected"), "cycle")
        .when(low.contains("403 forbidden") | low.contains("connection refused"), "network")
        .when(low.contains("concurrent map"), "data_race")
        .when(low.contains("not found") | low.contains("no such file"), "missing")
        .when(low.contains("syntax error") | low.contains("indentationerror"), "syntax")
        .otherwise("unknown")
    )


def missing_name(output: Column) -> Column:
    """What a missing-file message names, else ``executable``."""
    return F.coalesce(F.nullif(F.regexp_extract(output, r"(?i)([a-z0-9_\-.]+):\s*(?:not found|no such file)", 1), F.lit("")), F.lit("executable"))


def adopt(files: DataFrame) -> DataFrame:
    """(root, project_type, task, command, depends_on) of projects whose manifests (root, name, text) are there.

    The first adapter that finds a manifest decides for its root. Node tasks
    are those of package.json's scripts; Make targets are names before the
    first colon, without spaces or ``$``, that start with neither ``#`` nor ``.``.
    """
    rank = F.lit(None).cast("int")
    for r in range(len(ADAPTERS) - 1, -1, -1):
        rank = F.when(F.col("name").isin(*MANIFESTS[ADAPTERS[r]]), r).otherwise(rank)
    found = files.withColumn("rank", rank).where("rank IS NOT NULL")
    best = found.groupBy("root").agg(F.min(F.struct("rank", "name", "text")).alias("m")).select("root", "m.*")
    best = best.withColumn("project_type", F.element_at(F.array(*map(F.lit, ADAPTERS)), F.col("rank") + 1))
    module = F.element_at(F.split(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1), "/"), -1)
    task = lambda name, command, deps: F.struct(F.lit(name).alias("task"), command.alias("command"), F.array(*map(F.lit, deps)).cast("array<string>").alias("depends_on"))
    fixed = F.array().cast("array<struct<task:string,command:string,depends_on:array<string>>>")
    for kind, rows in TASKS.items():
        if kind == "Node.js":
            scripts = F.map_keys(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>"))
            there = F.filter(F.array(*(F.lit(n) for n, _, _ in rows)), lambda n: F.coalesce(F.array_contains(scripts, n), F.lit(False)))
            out = F.transform(there, lambda n: F.struct(n.alias("task"), F.when(n == "test", "npm test").otherwise(F.concat(F.lit("npm run "), n)).alias("command"), F.filter(F.array(F.when(n == "test", "lint").when(n == "build", "test")), lambda d: d.isNotNull() & F.array_contains(there, d)).alias("depends_on")))
        else:
            out = F.array(*(task(n, F.replace(F.lit(c), F.lit("{module}"), module), d) for n, c, d in rows))
        fixed = F.when(F.col("project_type") == kind, out).otherwise(fixed)
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[#.\t ]") & x.contains(":"))
    names = F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1))), lambda t: (t != "") & ~t.contains(" ") & ~t.contains("$")))
    made = F.transform(names, lambda t: F.struct(t.alias("task"), F.concat(F.lit("make "), t).alias("command"), F.array().cast("array<string>").alias("depends_on")))
    tasks = F.when(F.col("project_type") == "Makefile", made).otherwise(fixed)
    return best.select("root", "project_type", F.explode(tasks).alias("t")).select("root", "project_type", "t.*")


def config_diagnostics(tasks: DataFrame, default: str | None = None) -> DataFrame:
    """(task, problem, detail): empty commands, escaping folders, self and undefined dependencies, cycles, a missing default."""
    bad = lambda test, problem, detail: tasks.where(test).select(F.col("name").alias("task"), F.lit(problem).alias("problem"), detail.alias("detail"))
    out = bad(F.trim(F.coalesce("command", F.lit(""))) == "", "empty command", F.lit(""))
    out = out.union(bad(F.col("cwd").contains(".."), "folder escapes the workspace", F.col("cwd")))
    edges = edges_of(tasks)
    out = out.union(edges.where("src = dst").select(F.col("dst"), F.lit("depends on itself"), F.col("src")))
    out = out.union(ghosts(tasks).where("src <> dst").select("dst", F.lit("undefined dependency"), "src"))
    out = out.union(cycle_members(edges).select("node", F.lit("on a cycle"), "component"))
    if default:
        there = tasks.agg(F.count_if(F.col("name") == default).alias("n")).where("n = 0")
        out = out.union(there.select(F.lit(default), F.lit("default does not exist"), F.lit("")))
    return out


def doctor(blobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(check, value, status) on the cache and the last runs."""
    cache = blobs.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    failed = runs.agg(F.count_if(F.col("status") == "FAILED").alias("n"))
    row = lambda df, name, value, status: df.select(F.lit(name).alias("check"), value.cast("long").alias("value"), status.alias("status"))
    ok = lambda good: F.when(good, "OK").otherwise("WARN")
    return row(cache, "cache_entries", F.col("n"), ok(F.col("n") > 0)).union(row(cache, "cache_bytes", F.col("bytes"), F.lit("OK"))).union(row(failed, "failed_runs", F.col("n"), ok(F.col("n") == 0)))


def doctor_report(tasks: DataFrame | None, blobs: DataFrame, git: bool, system: str, units: str = "BKMGTPE") -> DataFrame:
    """(category, status, message) of the whole check-up; ``tasks`` is None where the definition can't be read.

    The graph fails on undefined dependencies and cycles and is left out
    without a definition; an empty cache is fine, and its size is told in ``units``.
    """
    spark = blobs.sparkSession
    row = lambda df, name, status, message: df.select(F.lit(name).alias("category"), status.alias("status"), message.alias("message"))
    one, ok, fail = spark.range(1), F.lit("OK"), F.lit("FAIL")
    if tasks is None:
        out = row(one, "Configuration", fail, F.lit("the definition can't be read"))
    else:
        out = row(tasks.agg(F.count("*").alias("n")), "Configuration", ok, F.format_string("%d tasks are defined", "n"))
        edges = edges_of(tasks)
        bad = ghosts(tasks).agg(F.count("*").alias("ghosts")).join(cycle_members(edges).agg(F.count("*").alias("cycle")).join(edges.where("src = dst").agg(F.count("*").alias("own"))))  # one row each
        broken = (F.col("ghosts") + F.col("cycle") + F.col("own")) > 0
        out = out.union(row(bad, "Dependency Graph", F.when(broken, fail).otherwise(ok), F.when(broken, F.format_string("%d undefined dependencies, %d tasks on cycles", "ghosts", F.col("cycle") + F.col("own"))).otherwise("no cycle and no undefined dependency")))
    cache = blobs.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    out = out.union(row(cache, "Cache Storage", ok, F.when(F.col("n") > 0, F.format_string("%d entries, %s", "n", format_bytes(F.col("bytes"), units))).otherwise("empty until the first run")))
    out = out.union(row(one, "Version Control", F.lit("OK" if git else "WARN"), F.lit("changed files can be asked for" if git else "no repository, so changed files can't be asked for")))
    return out.union(row(one, "System Resources", ok, F.lit(system)))


def doctor_result(report: DataFrame) -> DataFrame:
    """(n_failed, exit_code) of a report."""
    failed = F.count_if(F.col("status") == "FAIL")
    return report.agg(failed.alias("n_failed"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"))


def repair(line: Column, message: Column) -> Column:
    """A line of source after the simple repairs that its diagnostic asks for: a colon, closing brackets, an indent.

    Rules apply one after the other, each on what the one before left.
    """
    low = F.lower(message)
    opens = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    head = line.rlike(r"^\s*(?:def|class|if|elif|else|for|while|try|except|finally|with)\b") & ~F.rtrim(line).endswith(":")
    out = F.when((low.contains("expected ':'") | low.contains("missing colon")) & head, F.concat(F.rtrim(line), F.lit(":"))).otherwise(line)
    for a, b in ("()", "[]", "{}"):
        short = F.greatest(opens(a) - opens(b), F.lit(0))
        out = F.when(low.contains("never closed") | low.contains("unexpected eof"), F.concat(out, F.repeat(F.lit(b), short))).otherwise(out)
    return F.when(low.contains("expected an indented block"), F.concat(F.lit("    "), out)).otherwise(out)


def error_line(message: Column, n_lines: Column) -> Column:
    """The line number that a message gives, between 1 and the last line; 1 without one."""
    at = F.regexp_extract(message, r"(?i)line\s+(\d+)", 1)
    return F.when(at == "", 1).otherwise(F.greatest(F.lit(1), F.least(F.try_to_number(at, F.lit("9999999999")).cast("int"), n_lines)))

"""Workspace layout: categories, roles, target places, coupling and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.functions.paths import base_name, category, language, stem

# Patterns that give the role of a Python or JavaScript source, in the order of their rules.
PY_ENTRY = r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:"
PY_API = r"@(?:app|router|bp)\.(?:get|post|put|delete|patch|route)"
PY_MODEL = r"class\s+\w+\s*\([^)]*(?:BaseModel|db\.Model|Entity|dataclass)[^)]*\):"
PY_IMPORT = r"(?:from\s+([\w\.]+)\s+import|import\s+([\w\.]+))"
JS_ENTRY = r"^#!/usr/bin/env\s+node|program\.parse|cli\.run"
JS_API = r"(?:app|router)\.(?:get|post|put|delete|use)\s*\("
JS_MODEL = r"(?:export\s+)?(?:interface|type)\s+\w+\s*(?:\{|=|extends)|z\.object\("
JS_IMPORT = r"(?:import\s+.*?from\s+['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\))"


#: Files in the root, and documents or assets, from which on there is advice; the gain of a plan.
MOST_ROOT, MOST_LOOSE = 15, 3
ESTIMATED_GAIN = 119.0


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with is_root, category and language."""
    p = F.col(path)
    root = ~p.contains("/")
    return files.withColumns({"is_root": root, "category": category(p, root), "language": language(p)})


def imports(source: Column, lang: Column) -> Column:
    """Imported names in order, for Python, JavaScript and TypeScript; for Go the quoted paths of import declarations."""
    both = lambda p: F.transform(F.regexp_extract_all(source, F.lit(p), F.lit(0)), lambda m: F.coalesce(F.nullif(F.regexp_extract(m, p, 1), F.lit("")), F.regexp_extract(m, p, 2)))
    block = F.regexp_extract(source, r"(?s)\bimport\s*\(([^)]*)\)", 1)
    single = F.regexp_extract_all(source, F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    go = F.concat(F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)), single)
    return F.when(lang == "python", both(PY_IMPORT)).when(lang.isin("javascript", "typescript"), both(JS_IMPORT)).when(lang == "go", go).otherwise(F.array().cast("array<string>"))


def package_of(source: Column) -> Column:
    return F.regexp_extract(source, r"(?m)^package\s+(\w+)", 1)


def role(source: Column, lang: Column) -> Column:
    """entry, api, model, util, service or unknown.

    Python and JavaScript go by patterns. Go goes by an approximation of its
    syntax: patterns for the package, main function, handler parameters and
    type declarations, not a parser.
    """
    has = lambda p: source.rlike(p)
    none = F.size(imports(source, lang)) == 0
    python = F.when(has(PY_ENTRY), "entry").when(has(PY_API) | source.contains("FastAPI") | source.contains("Flask"), "api").when(has(PY_MODEL) | source.contains("@dataclass"), "model").when(none, "util").otherwise("service")
    script = F.when(has(JS_ENTRY), "entry").when(has(JS_API) | source.contains("express()"), "api").when(has(JS_MODEL), "model").when(none, "util").otherwise("service")
    n = F.size(imports(source, lang))
    handler = has(r"(?m)^func\s+(?:\([^)]*\)\s*)?\w+\([^)]*(?:ResponseWriter|Request)\b") | F.exists(imports(source, lang), lambda i: i.startswith("net/http"))
    go = (
        F.when((package_of(source) == "main") & has(r"(?m)^func\s+main\s*\("), "entry").when(handler, "api")
        .when(has(r"(?m)^type\s+\w+\s+(?:struct|interface)\b") & (n <= 2), "model").when((n == 0) & has(r"(?m)^func\s+\w+\s*\("), "util").when(n > 2, "service").otherwise("unknown")
    )
    return F.when(lang == "python", python).when(lang.isin("javascript", "typescript"), script).when(lang == "go", go).otherwise("unknown")


def target(path: Column, cat: Column, code_role: Column, cluster: Column, preset: str = "standard") -> Column:
    """struct(dest, package): where a file belongs in the standard or the clean layout. Anchors stay."""
    base = base_name(path)
    at = lambda package, *parts: F.struct(F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p for p in parts), base).alias("dest"), (F.lit(package) if isinstance(package, str) else package).alias("package"))
    out = F.when(cat == "root_anchor", F.struct(path.alias("dest"), F.lit("").alias("package")))
    for c in ("docs", "assets", "scripts", "configs", "testdata"):
        out = out.when(cat == c, at("", c))
    if preset == "clean":
        places = {"entry": ("main", "infra", "cmd"), "api": ("api", "adapters", "api"), "model": ("domain", "domain"), "service": ("usecases", "usecases"), "util": ("utils", "infra", "utils")}
        for r, (package, *parts) in places.items():
            out = out.when(code_role == r, at(package, *parts))
        return out.otherwise(at("domain", "domain"))
    name = F.when(stem(path) == "main", "app").otherwise(stem(path))
    service = F.when((cluster != "") & (cluster != base), cluster).otherwise("services")
    other = F.when(cluster != "", cluster).otherwise("core")
    return (
        out.when(code_role == "entry", at("main", "cmd", name)).when(code_role == "api", at("api", "internal", "api")).when(code_role == "model", at("models", "internal", "models"))
        .when(code_role == "service", at(service, "internal", service)).when(code_role == "util", at("utils", "pkg", "utils")).otherwise(at(other, "internal", other))
    )


def entropy(files: DataFrame) -> DataFrame:
    """One row on an inventory: totals, share of loose root files as a score to 1, and listing tokens. ``advice`` says what to do."""
    n, root = F.count("*"), F.count_if("is_root")
    score = F.when(n > 0, F.round(F.least(F.lit(1.0), root / n * F.lit(1.5)), 2)).otherwise(0.0)
    out = files.agg(n.alias("n_files"), root.alias("n_root"), F.countDistinct(F.when(~F.col("language").isin("", "other"), F.col("language"))).alias("n_languages"), score.alias("entropy"), (root * 14).alias("listing_tokens"))
    return out


def advice(files: DataFrame) -> DataFrame:
    """(rule, n, advice) of what an inventory with roles asks for: a crowded root, scattered documents or assets, loose entry points."""
    counted = files.agg(
        F.count_if("is_root").alias("root"), F.count_if(F.col("category") == "docs").alias("docs"), F.count_if(F.col("category") == "assets").alias("assets"), F.count_if(F.col("role") == "entry").alias("entry")
    )
    rule = lambda holds, name, n, text: F.when(holds, F.struct(F.lit(name).alias("rule"), n.alias("n"), text.alias("advice")))
    found = F.array(
        rule(F.col("root") > MOST_ROOT, "root", F.col("root"), F.format_string("%d files lie in the root; plan a layout that groups them", "root")),
        rule((F.col("docs") > MOST_LOOSE) | (F.col("assets") > MOST_LOOSE), "loose", F.greatest("docs", "assets"), F.lit("documents and images belong in folders of their own")),
        rule(F.col("entry") > 0, "entry", F.col("entry"), F.lit("entry points belong in one folder for each program")),
    )
    return counted.select(F.inline(F.array_compact(found)))


def category_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("n_files"), F.count_if("is_root").alias("n_root"))


def plan_metrics(files: DataFrame) -> DataFrame:
    """Listing and map tokens before and after a reorganisation; savings in percent, one decimal, none below zero."""
    counted = files.agg(F.count_if("is_root").alias("n_root"), F.count_if(F.col("category") == "code").alias("n_code"), F.countDistinct(F.when(F.col("category") == "code", F.col("package"))).alias("n_packages"))
    before = F.col("n_root") * 14
    after = F.when(F.col("n_root") > 8, F.lit(96)).otherwise(before)
    saved = F.when(before > 0, F.greatest(F.lit(0.0), F.round((before - after) * F.lit(100.0) / before, 1))).otherwise(0.0)
    return counted.select("n_root", "n_code", "n_packages", before.alias("listing_before"), after.cast("long").alias("listing_after"), saved.alias("savings_percent"), (F.col("n_code") * 85).alias("map_before"), (F.col("n_packages") * 45).alias("map_after"))


def plan_impact(files: DataFrame) -> DataFrame:
    """``plan_metrics`` with the gain that a plan is credited with."""
    return plan_metrics(files).withColumn("estimated_gain", F.lit(ESTIMATED_GAIN))


def coupling(files: DataFrame) -> DataFrame:
    """(u, v, w) between code files (path, imports): 2 in each direction for each import that holds the other's stem.

    An import can only hold a stem that is one of its substrings, so imports
    are cut into substrings of the lengths that stems have and equi-joined.
    """
    stems = files.select(F.col("path").alias("v"), stem(F.col("path")).alias("s")).where("s <> ''")
    lengths = stems.agg(F.array_sort(F.collect_set(F.length("s"))).alias("lengths"))
    used = files.select(F.col("path").alias("u"), F.explode("imports").alias("i"))
    pieces = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.length("i")), lambda k: (k > 0) & (k + n - 1 <= F.length("i"))), lambda k: F.substring(F.col("i"), k, n)))))
    # one row of different lengths
    held = used.join(F.broadcast(lengths)).select("u", "i", F.explode(pieces).alias("s")).join(stems, "s").select("u", "v")
    return held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u", "v").agg((F.count("*") * 2).cast("double").alias("w"))


def package_edges(files: DataFrame) -> DataFrame:
    """(src, dst) of packages: a file's new package depends on each other package that one of its imports holds."""
    packages = files.where("package <> ''").select(F.col("package").alias("src")).distinct()
    lengths = packages.agg(F.array_sort(F.collect_set(F.length("src"))).alias("lengths"))
    used = files.where("package <> ''").select(F.col("package").alias("dst"), F.explode("imports").alias("i")).distinct()
    pieces = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.length("i")), lambda k: (k > 0) & (k + n - 1 <= F.length("i"))), lambda k: F.substring(F.col("i"), k, n)))))
    return used.join(F.broadcast(lengths)).select("dst", F.explode(pieces).alias("src")).join(packages, "src").where("src <> dst").select("src", "dst").distinct()

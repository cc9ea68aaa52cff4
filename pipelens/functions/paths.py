"""Path expressions: parts of a path, file categories and languages, the workspace jail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the classifier knows by name or extension, in the order in which its rules apply.
ROOT_ANCHORS = (
    "go.mod", "go.sum", "go.work", "tasks.json", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
    "tsconfig.json", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "makefile", "readme.md", "license",
    "license.md", "license.txt", ".gitignore", ".gitattributes", ".editorconfig",
)
DOC_NAMES = ("contributing.md", "changelog.md")
DOC_EXTENSIONS = (".md", ".rst", ".adoc", ".pdf")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".svg", ".ico", ".gif", ".webp", ".bmp", ".ttf", ".woff", ".woff2")
SCRIPT_EXTENSIONS = (".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd")
TESTDATA_WORDS = ("mock", "fixture", "sample")
CONFIG_PREFIXES = ("dockerfile", "docker-compose")
CONFIG_EXTENSIONS = (".toml", ".yaml", ".yml", ".ini", ".conf")
CODE_EXTENSIONS = (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".rs", ".c", ".cpp", ".h", ".java")
LANGUAGES = {"go": (".go",), "python": (".py",), "javascript": (".js", ".jsx"), "typescript": (".ts", ".tsx"), "rust": (".rs",), "shell": (".sh", ".bash", ".ps1")}
#: Directories that a walk leaves out, and names that devices own.
IGNORED_DIRS = (".git", ".taskcache", "node_modules", "vendor", "dist", "build", ".cache", ".hg", ".svn")
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
#: Files whose names mark them as sensitive.
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", ".env.staging", "credentials.json", "secrets.json", "secrets.yaml", "secrets.yml")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the last segment on, the dot included; empty without one."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def category(path: Column, is_root: Column) -> Column:
    """The category of a file; the first rule that applies decides."""
    base, ext = F.lower(base_name(path)), F.lower(extension(path))
    holds = lambda words, test: F.lit(False) if not words else _any([test(w) for w in words])
    return (
        F.when(is_root & base.isin(*ROOT_ANCHORS), "root_anchor")
        .when(base.isin(*DOC_NAMES) | base.startswith("rfc"), "docs")
        .when(ext.isin(*DOC_EXTENSIONS), "docs")
        .when(ext.isin(*ASSET_EXTENSIONS), "assets")
        .when(ext.isin(*SCRIPT_EXTENSIONS), "scripts")
        .when(holds(TESTDATA_WORDS, base.contains), "testdata")
        .when(holds(CONFIG_PREFIXES, base.startswith) | ext.isin(*CONFIG_EXTENSIONS), "configs")
        .when(ext.isin(*CODE_EXTENSIONS), "code")
        .otherwise("docs")
    )


def language(path: Column) -> Column:
    ext, out = F.lower(extension(path)), None
    for name, extensions in LANGUAGES.items():
        out = (F.when if out is None else out.when)(ext.isin(*extensions), name)
    return out.otherwise("other")


def is_sensitive(path: Column) -> Column:
    base = F.lower(base_name(path))
    return base.startswith(".env") | base.endswith(".key") | base.endswith(".pem") | base.isin(*SENSITIVE_NAMES)


def violation(path: Column) -> Column:
    """The first rule of the workspace jail that a path breaks; null if it stays inside.

    The path is resolved without a file system: empty and ``.`` segments go,
    ``..`` removes the segment before it or, at the top, escapes.
    """
    lower = F.lower(path)
    names = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: F.upper(F.substring_index(s, ".", 1)))
    depth = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.array_append(acc, s)),
    )
    return (
        F.when(path.contains("\x00"), "null_byte")
        .when(path.contains(":"), "colon")
        .when(_any([lower.contains(x) for x in ("%2e", "%2f", "%5c", "%00")]), "percent_encoded")
        .when(F.arrays_overlap(names, F.array(*map(F.lit, DEVICES))), "device_name")
        .when(path.startswith("/") | path.startswith("\\"), "absolute")
        .when(F.coalesce(F.get(depth, F.lit(0)), F.lit("")).startswith(".."), "escapes")
    )


def walked(path: Column, pattern: str) -> Column:
    """Whether a walk for ``pattern`` reaches the path: ignored directories only where the pattern names them."""
    shut = [d for d in IGNORED_DIRS if d not in pattern.split("/")]
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, shut)).cast("array<string>"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out

"""Environment variables and log lines: parsing, classification, masking, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are public, words that make a name secret, and shapes of credential values.
PUBLIC_NAMES = (
    "PORT", "HOST", "ENV", "ENVIRONMENT", "DEBUG", "LOG_LEVEL", "LOG_FORMAT", "NODE_ENV", "APP_NAME", "APP_ENV", "VERSION",
    "TZ", "TIMEZONE", "TIMEOUT", "WORKERS", "REGION", "AWS_REGION", "AWS_DEFAULT_REGION", "DATABASE_DRIVER",
    "DB_HOST", "DB_PORT", "DB_NAME", "REDIS_HOST", "REDIS_PORT",
)
SECRET_WORDS = ("KEY", "SECRET", "PASSWORD", "PASSWD", "PASS", "TOKEN", "AUTH", "PRIVATE", "CREDENTIAL", "SALT", "SIGNING", "CERT", "BEARER", "DSSE", "ACCESS_KEY", "APIKEY")
TOKEN_SHAPES = (r"sk-[a-zA-Z0-9_-]{20,}", r"gh[pousr]_[a-zA-Z0-9]{20,}", r"AKIA[0-9A-Z]{16}")
OTHER_SHAPES = (r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}", r"(?i)(?:postgres|postgresql|mysql|mongodb|redis)://[^:\s]+:([^@\s]+)@")
PLACEHOLDERS = ("your_", "replace_me", "insert_here", "dummy", "placeholder")
#: What redaction masks whole, and the parts of its last rule.
MASKED = (r"(?i)bearer\s+[A-Za-z0-9_\-.]{16,}", r"(?i)ghp_[A-Za-z0-9]{36,}", r"(?i)sk_live_[A-Za-z0-9]{24,}", r"(?i)AKIA[0-9A-Z]{16}")
NAMED = "(?:key|token|secret|password|passwd|auth)"
VALUE = r"""['"]?[A-Za-z0-9_\-/+=]{8,}['"]?"""
MASK = "***REDACTED***"

TOKEN_PREFIX = "VAULT_SECRET_"


def redact(text: Column) -> Column:
    """``text`` with credentials masked; of a named value with ``:`` or ``=`` the name stays.

    The last rule runs once, with markers around what stays, so that what one
    match has masked is not matched again.
    """
    for pattern in MASKED:
        text = F.regexp_replace(text, pattern, MASK)
    text = F.regexp_replace(text, rf"(?i)(?:({NAMED}\s*)[:=][\s:=]*{VALUE}|{NAMED}\s+{VALUE})", f"\x01$1\x02{MASK}")
    for old, new in (("\x01\x02", ""), ("\x01", ""), ("\x02", "=")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def env_entry(line: Column) -> Column:
    """struct(key, value, is_comment) of a line of an environment file.

    Blank lines and ``#`` lines are comments. Without ``=`` the whole line is
    the key. One pair of equal quotes around the value goes.
    """
    clean = F.trim(line, F.lit(" \t\r\n\x0b\x0c"))
    at = F.instr(line, "=")
    key = F.trim(F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line), F.lit(" \t\r\n\x0b\x0c"))
    value = F.trim(F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(F.lit("")), F.lit(" \t\r\n\x0b\x0c"))
    value = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1\z""", "$2")
    comment = (clean == "") | clean.startswith("#")
    return F.when(comment, F.struct(F.lit("").alias("key"), F.lit("").alias("value"), F.lit(True).alias("is_comment"))).otherwise(
        F.struct(key.alias("key"), value.alias("value"), F.lit(False).alias("is_comment"))
    )


def risk(key: Column, value: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW; all but LOW are secrets. Lengths are in bytes."""
    name, val = F.upper(F.trim(key)), F.trim(value)
    # one search for all shapes, and one for all words, which keeps generated code small
    shaped = val.rlike("|".join(TOKEN_SHAPES))
    other = "|".join(f"(?i:{p.removeprefix('(?i)')})" if p.startswith("(?i)") else p for p in OTHER_SHAPES)
    return (
        F.when(name.isin(*PUBLIC_NAMES) & ~shaped, "LOW")
        .when(shaped | val.rlike(other), "CRITICAL")
        .when(name.rlike("|".join(SECRET_WORDS)) & ~val.isin("", '""', "''"), "HIGH")
        .when((F.octet_length(val) >= 32) & ~val.contains(" ") & ~val.startswith("http"), "MEDIUM")
        .otherwise("LOW")
    )


def mask(value: Column) -> Column:
    """First and last three characters of a trimmed value longer than six bytes; six stars for others."""
    val = F.trim(value)
    return F.when(F.octet_length(val) <= 6, "******").otherwise(F.concat(F.left(val, F.lit(3)), F.lit("..."), F.right(val, F.lit(3))))


def cloak_token(key: Column, value: Column, prefix: str = TOKEN_PREFIX) -> Column:
    """A placeholder that key and value determine."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(key, F.lit(":"), value), 256), F.lit(8)))


def is_placeholder(value: Column) -> Column:
    low = F.lower(value)
    return _any([low.contains(w) for w in PLACEHOLDERS]) | value.isin("", '""', "''")


def expand_variables(text: Column, env: Column) -> Column:
    """``${NAME}`` and ``${NAME:-default}`` from a map of variables; an empty variable counts as unset."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{[A-Za-z_][A-Za-z0-9_]*(?::-[^}]*)?\}"), F.lit(0)))

    def put(done: Column, token: Column) -> Column:
        name = F.regexp_extract(token, r"^\$\{([A-Za-z_][A-Za-z0-9_]*)", 1)
        default = F.regexp_extract(token, r":-([^}]*)\}$", 1)
        return F.replace(done, token, F.coalesce(F.nullif(F.element_at(env, name), F.lit("")), default))

    return F.aggregate(found, text, put)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out

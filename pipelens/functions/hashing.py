"""Digests of maps, tasks and records; units of size and duration."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(m: Column, prefix: str = "") -> Column:
    """``prefix key:value`` lines of a map in byte order of its keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(prefix), e["key"], F.lit(":"), e["value"], F.lit("\n"))), "")


def merkle_digest(m: Column) -> Column:
    """SHA-256 over the sorted entries of a map of strings; empty for an empty or null map."""
    return F.when(F.coalesce(F.size(m), F.lit(0)) <= 0, "").otherwise(F.sha2(_lines(m), 256))


def task_fingerprint(name: Column, command: Column, cwd: Column, shell: Column, pure: Column, files: Column, env: Column, deps: Column, outputs: Column) -> Column:
    """SHA-256 of what a task depends on: its own fields, then files, environment, dependencies and output patterns, each sorted."""
    parts = [F.concat(F.lit(label), value, F.lit("\n")) for label, value in (("task_name:", name), ("command:", command), ("cwd:", cwd), ("shell:", shell), ("pure:", pure.cast("string")))]
    patterns = F.array_join(F.transform(F.array_sort(outputs), lambda p: F.concat(F.lit("output_pattern:"), p, F.lit("\n"))), "")
    return F.sha2(F.concat(*parts, _lines(files, "file:"), _lines(env, "env:"), _lines(deps, "dep:"), patterns), 256)


def is_digest(text: Column) -> Column:
    return (F.length(text) == 64) & ~text.rlike(r"[./\\]")


def shard_path(digest: Column) -> Column:
    """The first two digits as a folder, the rest as the name."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, F.lit(3), F.length(digest)))


def format_bytes(n: Column, units: str = "BKMGTPE") -> Column:
    """Powers of 1024 with one decimal, halves to even; plain bytes below 1024. ``units`` names the neighbouring units that are used, others go by the nearest."""
    out = n.cast("string")
    for unit in units:
        k = "BKMGTPE".index(unit)
        at = F.format_string(f"%.1f {unit}B", F.bround(n / F.lit(float(1024**k)), 1)) if k else F.concat(n.cast("string"), F.lit(" B"))
        out = at if unit == units[0] else F.when(n < 1024**k, out).otherwise(at)
    return out


def parse_bytes(text: Column) -> Column:
    """Whole numbers with GB, MB, KB, B or no unit, in powers of 1024; null for others."""
    clean = F.upper(F.trim(text))
    unit = F.regexp_extract(clean, r"^\d+\s*([GMK]?B)?$", 1)
    n = F.regexp_extract(clean, r"^(\d+)\s*(?:[GMK]?B)?$", 1)
    scale = F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1)
    return F.when(n != "", n.cast("long") * scale)


def parse_seconds(text: Column) -> Column:
    """Durations like ``1h30m``, ``250ms`` or ``7d`` in seconds; null for others."""
    clean = F.trim(text)
    parts = F.regexp_extract_all(clean, F.lit(r"\d+(?:\.\d+)?(?:ms|us|ns|d|h|m|s)"), F.lit(0))
    scale = {"d": 86400.0, "h": 3600.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "m": 60.0, "s": 1.0}

    def seconds(p: Column) -> Column:
        unit, n = F.regexp_extract(p, r"[a-z]+$", 0), F.regexp_extract(p, r"^[0-9.]+", 0).cast("double")
        value = F.lit(0.0)
        for u, k in scale.items():
            value = F.when(unit == u, n * k).otherwise(value)
        return value

    whole = clean.rlike(r"^(?:\d+(?:\.\d+)?(?:ms|us|ns|d|h|m|s))+$")
    return F.when(whole, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + seconds(p)))


def hmac_sha256(secret: bytes):
    """A function of a text column: its HMAC-SHA256 in hex, of two digests under the padded secret."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return lambda text: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def verify_hmac(secret: bytes):
    """A function of a text and a signature column: whether the hex signature, in any case, is the text's; never for an empty or null one."""
    sign = hmac_sha256(secret)
    return lambda text, signature: F.coalesce(F.lower(signature) == sign(text), F.lit(False))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON again with sorted keys, no spaces, numbers as written and ``< > &`` escaped; null if it isn't JSON."""

    def again(x):
        try:
            value = json.loads(x, parse_float=_Exact, parse_int=_Exact)
        except (TypeError, ValueError):
            return None
        out = _dump(value)
        for c in "<>&":
            out = out.replace(c, f"\\u{ord(c):04x}")
        return out

    return text.map(again)


class _Exact(str):
    """A number as it was written."""


def _dump(value) -> str:
    if isinstance(value, _Exact):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _dump(value[k]) for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return str(value) if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.LongType())
def first_byte_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first offset at which two binaries differ; the shorter length if one begins the other, -1 if equal, null with a null."""

    def at(x, y):
        if x is None or y is None:
            return None
        if x == y:
            return -1
        n = min(len(x), len(y))
        lo, hi = 0, n
        while lo < hi:  # the shortest prefix that differs
            mid = (lo + hi) // 2
            if x[lo : mid + 1] == y[lo : mid + 1]:
                lo = mid + 1
            else:
                hi = mid
        return lo

    return pd.Series([at(x, y) for x, y in zip(a, b)], dtype="Int64")

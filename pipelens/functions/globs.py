"""Glob patterns as predicates, compiled while the plan is built.

A constant pattern becomes an equality, a prefix or suffix test where it can,
which Parquet scans take over, and a regular expression where it must.
``matches`` is the general matcher; ``matches_prefix`` is the variant for which
``**`` means anything behind its prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipelens.functions.paths import base_name


def segment_regex(pattern: str) -> str | None:
    """A whole-string regular expression of ``* ? [..] \\`` patterns whose wild cards stop at ``/``; None if malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
        elif c == "[":
            m = re.compile(r"\[(\^?)((?:\\.|[^\\\]])+)\]").match(pattern, i)
            inside = _ranges(m[2]) if m else None
            if inside is None:
                return None
            # a class of nothing but empty ranges fits no character, its negation every one
            out += f"[{m[1]}{inside}]" if inside else "." if m[1] else "(?!)"
            i = m.end() - 1
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def _ranges(body: str) -> str | None:
    """The inside of a character class, every character escaped; None if a range has no end."""
    chars = re.findall(r"\\.|[^\\]", body)
    plain = [c[-1] for c in chars]
    out, i = "", 0
    while i < len(chars):
        if chars[i] == "-":
            return None
        if i + 1 < len(chars) and chars[i + 1] == "-":
            if i + 2 >= len(chars) or chars[i + 2] == "-":
                return None
            if plain[i] <= plain[i + 2]:
                out += re.escape(plain[i]) + "-" + re.escape(plain[i + 2])
            i += 3
        else:
            out += "\\" + plain[i] if plain[i] in "^]\\[-&" else re.escape(plain[i])
            i += 1
    return out


def _wild(pattern: str) -> bool:
    return any(c in pattern for c in "*?[\\")


def segment_match(text: Column, pattern: str) -> Column:
    if not _wild(pattern):
        return text == pattern
    regex = segment_regex(pattern)
    return F.lit(False) if regex is None else text.rlike(regex)


def _path_or_base(path: Column, pattern: str) -> Column:
    """The pattern against the whole path or its last segment."""
    if not _wild(pattern) and "/" not in pattern:
        return (path == pattern) | path.endswith("/" + pattern)
    if pattern.startswith("*") and not _wild(pattern[1:]) and "/" not in pattern:
        return path.endswith(pattern[1:])
    if "/" in pattern:  # a last segment has none
        return segment_match(path, pattern)
    return segment_match(path, pattern) | segment_match(base_name(path), pattern)


def matches(path: Column, pattern: str) -> Column:
    """Whether a path fits a pattern.

    With exactly one ``**`` the path must start with what stands before it
    (without a closing ``/``, and without a check that a segment ends there);
    the rest is empty, or ``*`` and a literal end, or fits the rest of the
    path, its last segment, or is its literal end. All other patterns fit the
    path or its last segment. A malformed pattern fits only itself.
    """
    if pattern.count("**") != 1:
        return (path == pattern) | _path_or_base(path, pattern)
    prefix, suffix = pattern.split("**")
    prefix, suffix = prefix.removesuffix("/"), suffix.removeprefix("/")
    starts = path.startswith(prefix) if prefix else F.lit(True)
    if not suffix:
        return (path == pattern) | starts
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    rest = F.when(rest.startswith("/"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    if suffix.startswith("*"):
        fits = rest.endswith(suffix[1:])
    else:
        fits = segment_match(rest, suffix) | segment_match(base_name(path), suffix) | rest.endswith(suffix)
    return (path == pattern) | (starts & fits)


def matches_prefix(path: Column, pattern: str) -> Column:
    """The variant without a last-segment rule: ``**`` tests its prefix alone."""
    if "**" in pattern:
        head = pattern.split("**")[0].removesuffix("/")
        return segment_match(path, pattern) | (path.startswith(head) if head else F.lit(True))
    return segment_match(path, pattern)


def any_match(path: Column, patterns: list[str], match=matches) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | match(path, p)
    return out


def as_regex(pattern: str, match=matches) -> tuple[str, str]:
    """(head, regex) of a pattern: what every path begins with that fits, and a whole-string regular expression of the same paths.

    For patterns that are rows, not constants: heads are equi-joined with
    beginnings of paths, and the expression decides. The head is empty where a
    last segment anywhere can fit.
    """
    quote = lambda t: "".join("\\" + c if not (c.isalnum() or c in "_/ ") else c for c in t)
    segment = lambda t: None if (r := segment_regex(t) if _wild(t) else f"(?s)^{quote(t)}\\z") is None else r[5:-2]
    head = re.split(r"[*?\[\\]", pattern, maxsplit=1)[0]
    ways = [quote(pattern), segment(pattern)]
    if match is matches_prefix:
        if "**" in pattern:
            ways.append(quote(pattern.split("**")[0].removesuffix("/")) + ".*")
            head = head.removesuffix("/")
    elif pattern.count("**") == 1:
        prefix, suffix = pattern.split("**")
        prefix, suffix = prefix.removesuffix("/"), suffix.removeprefix("/")
        start, ways, head = quote(prefix), [quote(pattern)], head.removesuffix("/")
        if not suffix:
            ways.append(start + ".*")
        elif suffix.startswith("*"):
            ways.append(f"{start}/?+.*{quote(suffix[1:])}")
        else:
            own = segment(suffix)
            ways.append(f"{start}/?+.*{quote(suffix)}")
            if own is not None:
                ways += [f"{start}/?+{own}", f"(?={start})(?:.*/)?(?=[^/]*\\z){own}"]
    elif "/" not in pattern:
        own = segment(pattern)
        head = ""
        if pattern.startswith("*") and not _wild(pattern[1:]):
            ways.append(".*" + quote(pattern[1:]))
        elif own is not None:
            ways.append(f"(?:.*/)?(?=[^/]*\\z){own}")
    return head, "(?s)^(?:" + "|".join(w for w in ways if w is not None) + ")\\z"


def anchor(pattern: str, match=matches) -> tuple[str, str, str]:
    """(kind, key, regex) of a pattern: what every path that fits begins with, ends with or holds, and ``as_regex``'s expression.

    The kind is ``head``, ``tail``, ``inside`` or, for patterns without any
    text that is sure, such as ``**`` or ``[ab]?``, ``none``.
    """
    head, regex = as_regex(pattern, match)
    if head:
        return "head", head, regex
    sure, end = pattern, pattern
    if match is matches_prefix:
        if "**" in pattern:
            sure, end = pattern.split("**")[0].removesuffix("/"), ""
    elif pattern.count("**") == 1:
        prefix, suffix = pattern.split("**")
        end = suffix.removeprefix("/")
        sure = f"{prefix.removesuffix('/')}*{end}"
    tail = re.split(r"[*?\[\]\\]", end)[-1]
    if tail:
        return "tail", tail, regex
    held = max(re.split(r"[*?\[\]\\]", re.sub(r"\[\^?(?:\\.|[^\\\]])+\]", "*", sure)), key=len)
    return ("inside", held, regex) if held else ("none", "", regex)

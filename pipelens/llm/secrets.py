"""Secret scans with multipart credential linking.

Base patterns report on their own. Weak parts do not: an unlabelled key-like
token, an account name or an endpoint is common and harmless alone. Parts are
joined by position within a scope, a paragraph and ``REACH`` characters around,
and weak candidates are reported only where complementary parts (an identifier,
a secret and, for named accounts, an endpoint) meet. The interval join is a
sweep over the sorted parts of one text: whether a part has
a partner of another kind, the nearest of that kind tells, so work and result
are linear in the parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import slices

#: Base patterns, in the order of their kinds; the letters of the first are in either case, ASCII only.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
#: Words without which the first pattern can't match.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weak parts: a token that mixes cases and digits, an account name, an endpoint. A token is taken whole and looked at then, so that time is linear.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
USER = re.compile(r"(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>|]{3,}|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}", re.I | re.A)
DIGIT, LOWER, UPPER = (re.compile(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))
REACH = 200


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, code points, end exclusive; leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(x in low for x in HINTS):
        out += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_key(token: str) -> bool:
    """Whether a token looks like a key: 16 characters with digits and both cases, and at most two ``=``, at its end."""
    body = token.rstrip("=")
    return len(body) >= 16 and len(token) - len(body) <= 2 and "=" not in body and all(x.search(body) for x in (DIGIT, LOWER, UPPER))


def weak_spans(text: str) -> list[Span]:
    """Weak parts of a text. What a pattern can't do without is looked for first, as most texts have none of it."""
    out, low = [], text.lower()
    if DIGIT.search(text):
        out += [Span(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_key(m[0])]
    if any(x in low for x in ("user", "login", "account", "client")):
        out += [Span(m.start(1), 4, m.end(1)) for m in USER.finditer(text)]
    if "://" in text or any(x in low for x in ("host", "endpoint", "server")):
        out += [Span(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return out


def linked(text: str, base: list[Span]) -> list[Span]:
    """Weak spans that complementary parts vouch for, in order.

    A key counts near an access identifier, or near an account name with an
    endpoint; the account name and the endpoint count with it. A secret of the
    base patterns does for the key. Parts are near if one paragraph holds them
    and at most ``REACH`` characters lie between.
    """
    starts, ends_so_far = [b.start for b in base], list(accumulate((b.end for b in base), max))
    inside = lambda s: (i := bisect_right(starts, s.start)) > 0 and ends_so_far[i - 1] >= s.end
    weak = [s for s in weak_spans(text) if s.kind != 3 or not inside(s)]  # a key within a base span is reported already
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    by_kind: dict[int, list[Span]] = {}
    for s in sorted({*base, *weak}):
        by_kind.setdefault(s.kind, []).append(s)

    def close(s: Span, *rows: list[Span]) -> bool:
        """Whether a part of the rows, each of one kind, is in the scope: the nearest on either side tells."""
        for row in rows:
            i = bisect_left(row, s)
            for x in row[max(0, i - 1) : i + 1]:
                gap = max(x.start - s.end, s.start - x.end)
                apart = bisect_left(breaks, min(x.start, s.start)) != bisect_left(breaks, max(x.start, s.start))
                if gap <= REACH and not apart:
                    return True
        return False

    assigned, access, hexes, keys, users, ends = (by_kind.get(kind, []) for kind in range(len(KINDS)))
    # each part is decided from its own side, so any number of them can share an account name
    placed = [u for u in users if close(u, ends)]
    trusted = [u for u in users if close(u, assigned, hexes, keys)]
    out = {k for k in keys if close(k, access, placed)}
    out.update(u for u in placed if close(u, assigned, hexes, keys))
    out.update(e for e in ends if close(e, trusted))
    return sorted(out)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the base spans and all spans as text.

    Returned: doc_id, n_assign, n_access, n_hex, base_spans, spans. Spans are
    kind:start:end by start, then kind in the order of ``KINDS``. Null and
    empty texts have none; repeated rows and null ids are kept; an empty table
    gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                for k in range(3):
                    columns[k].append(sum(s.kind == k for s in base))
                columns[3].append(spans_text(base))
                columns[4].append(spans_text(sorted({*base, *linked(t or "", base)})))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")

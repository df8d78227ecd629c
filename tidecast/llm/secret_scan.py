"""Secret scans with multipart credential linking.

Three strong kinds (``assign``, ``access``, ``hex``) are always reported.  Three weak kinds mean nothing
alone: ``identifier`` (a user or client name after its keyword), ``material`` (a long token of mixed letters
and digits) and ``endpoint`` (an address with a scheme).  Parts of a credential are linked by an interval
join: every part's scope reaches ``SCOPE`` code points beyond its ends, and two parts are joined if a scope
meets the other part.  An identifying part (access, identifier) and a secret part (assign, hex, material)
that are joined make a credential: its weak parts are reported, and an endpoint is reported if it is in the
scope of both sides of credentials.  Weak parts without their complement are never reported.

A document's text is scanned whole, in one task; a linear-time expression sorts out the texts that cannot
have any part, so that most texts are read once by it only.  The join takes sorted ends and binary search:
n parts cost n log n, whatever their number in a scope.

Spans are code points, end exclusive, of the whole match.  Defined cases: null texts scan as empty ones;
weak parts that overlap a strong span are dropped; equal spans of one kind cannot occur; repeated rows
each give a row; other columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, per_document, portions

#: Code points between two parts that may belong together.
SCOPE = 200

#: Kinds in the order of the report.
KINDS = ("assign", "access", "hex", "identifier", "material", "endpoint")
STRONG = KINDS[:3]

# The base patterns, and the least length of what they have to match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

# Weak parts.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:[A-Za-z0-9]++[_-])*?(?:user(?:_?name)?|login|client_?id|app_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?"""
    r"""[A-Za-z0-9._@-]{3,}""",
    re.ASCII | re.IGNORECASE,
)
MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.ASCII | re.IGNORECASE)

#: Texts that these do not match have no part that could be reported (linear-time engine, one pass each).
MAY_BE_STRONG = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
MAY_BE_WEAK = (
    r"""(?i:user(?:_?name)?|login|client_?id|app_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]"""
)

Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    """(start, end, kind), leftmost and not overlapping within a kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that do not overlap a strong span."""
    found = [(*m.span(), "identifier") for m in IDENTIFIER.finditer(text)]
    found += [(*m.span(), "material") for m in MATERIAL.finditer(text) if _mixed(m[0])]
    found += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    if not strong or not found:
        return found
    clash = joined(found, strong, 0)
    return [s for s, c in zip(found, clash) if not c]


def joined(left: list[Span], right: list[Span], scope: int) -> np.ndarray:
    """Whether each left span has a right one that overlaps it after growing ``scope`` points both ways."""
    if not left or not right:
        return np.zeros(len(left), bool)
    r = np.array(sorted((s, e) for s, e, _ in right))
    furthest = np.maximum.accumulate(r[:, 1])
    starts, ends = (np.array([x[k] for x in left]) for k in (0, 1))
    before = np.searchsorted(r[:, 0], ends + scope, "left")
    return (before > 0) & (furthest[np.maximum(before - 1, 0)] > starts - scope)


def linked(strong: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans whose complements co-occur."""
    def of(*kinds: str) -> list[Span]:
        return [s for s in (*strong, *weak) if s[2] in kinds]

    identifying, secret = of("access", "identifier"), of("assign", "hex", "material")
    known = [s for s, j in zip(identifying, joined(identifying, secret, scope)) if j]
    held = [s for s, j in zip(secret, joined(secret, identifying, scope)) if j]
    ends = of("endpoint")
    at = joined(ends, known, scope) & joined(ends, held, scope)
    return [s for s in (*known, *held) if s[2] not in STRONG] + [s for s, j in zip(ends, at) if j]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in in_order(spans))


def scan(texts: pa.Array, scope: int = SCOPE) -> Iterator[tuple[list[Span], list[Span]]]:
    """The strong spans and the linked weak ones of each text."""
    texts = pc.fill_null(texts, "")
    strong = pc.match_substring_regex(texts, MAY_BE_STRONG).to_pylist()
    weak = pc.match_substring_regex(texts, MAY_BE_WEAK).to_pylist()
    for text, s, w in zip(texts, strong, weak):
        if not s and not w:
            yield [], []
            continue
        text = text.as_py()
        base = strong_spans(text) if s else []
        # Without an identifying part there is no credential.
        needed = w or any(k == "access" for _, _, k in base)
        yield base, linked(base, weak_spans(text, base), scope) if needed else []


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row."""

    def work(batch: pa.RecordBatch) -> list:
        rows = list(scan(batch.column("text"), scope))
        count = [pa.array([sum(k == kind for *_, k in base) for base, _ in rows], pa.int64()) for kind in STRONG]
        digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
        every = [written(base + more) for base, more in rows]
        return [batch.column("doc_id"), *count, digest, every, pa.array([len(more) for _, more in rows], pa.int64())]

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return per_document(docs, {"doc_id": "long", "text": "string"}, schema, work)


def without_spans(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by [kind]."""
    out, at, last = [], 0, 0
    for a, b, kind in in_order(spans):
        if a >= last:
            out += [text[at:a], f"[{kind}]"]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The table with the secrets of column ``text`` replaced, and ``n_chars``, where it is, counted anew in
    rows that changed; every row and every other column stays."""
    names, schema = docs.columns, to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                columns = dict(zip(names, part.columns))
                texts = columns["text"].to_pylist()
                sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i, (base, more) in enumerate(scan(columns["text"], scope)):
                    if base or more:
                        texts[i] = without_spans(texts[i], base + more)
                        if sizes:
                            sizes[i] = len(texts[i])
                columns["text"] = pa.array(texts, schema.field("text").type)
                if sizes:
                    columns["n_chars"] = pa.array(sizes, schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns.values(), schema)], schema=schema)

    return arrow_map(docs, run, docs.schema)

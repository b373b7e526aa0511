"""Secrets in texts, and the parts of one credential that stand near each other.

Strong candidates are told by their own form: assigned values, access identifiers and hexadecimal runs. Weak ones (a mixed-case token, a named identifier, an
address) mean little alone. Each identifier opens a scope, an interval of so many characters on both sides; the weak candidates are joined to the scopes by
their offsets, and one is reported only where its complement is in the same scope: a weak secret with an identifier, a weak identifier with a secret, and an
endpoint with both. The join runs over the sorted offsets of one text, so it is linear in what it finds and needs no shuffle.

Null texts count as empty; empty texts have no span. Rows that repeat stay rows of their own; an empty table gives an empty result. Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from convolake.llm.common import texts

#: Kinds in the order in which spans of one start are listed. Fixed values.
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
#: The three strong forms. Fixed values of the contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the same as any run of which those under 16 are dropped
LEAST = {"assign": 12, "access": 18}
#: Without one of these, in lower case, no value is assigned.
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: The weak forms.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,64}(?![A-Za-z0-9+/_=-])")
NAMED = re.compile(r"""\b(?i:access_?key_?id|client_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.ASCII)
ADDRESS = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b""")

_HEX_BYTES = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))

Span = tuple[int, int, str]


def strong(text: str) -> list[Span]:
    """(start, end, kind) of the strong candidates, each kind leftmost and without overlaps."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    out: list[Span] = []
    if any(name in lower for name in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * 16 in raw.translate(_HEX_BYTES):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def linked(text: str, base: list[Span], scope: int) -> list[Span]:
    """The weak candidates that have their complement in the scope of an identifier."""
    names = [m.span() for m in NAMED.finditer(text)]
    ids = sorted([(s, e, True) for s, e, k in base if k == "access"] + [(s, e, False) for s, e in names])
    if not ids:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not k or reach[k - 1] <= s

    def varied(token: str) -> bool:
        return any(c.islower() for c in token) and any(c.isupper() for c in token) and any(c.isdigit() for c in token)

    secrets = sorted([(s, e, True) for s, e, k in base if k != "access"] + [(*m.span(), False) for m in TOKEN.finditer(text) if varied(m[0]) and free(*m.span())])
    places = sorted(m.span() for m in ADDRESS.finditer(text))
    secret_at, place_at = [s for s, _, _ in secrets], [s for s, _ in places]
    found: set[Span] = set()
    for s, e, sure in ids:
        near = secrets[bisect_left(secret_at, s - scope) : bisect_right(secret_at, e + scope)]
        near = [x for x in near if x[1] <= s or x[0] >= e]
        if not near:
            continue
        if not sure and free(s, e):
            found.add((s, e, "identifier"))
        found.update((a, b, "secret") for a, b, own in near if not own)
        found.update((a, b, "endpoint") for a, b in places[bisect_left(place_at, s - scope) : bisect_right(place_at, e + scope)])
    return sorted(found)


def scan(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and its spans as an array of (kind, start, end, strong), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strong", pa.bool_())]))
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base = strong(t)
                every = sorted([*base, *linked(t, base, scope)], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                out.append([{"kind": k, "start": s, "end": e, "strong": k in KINDS[:3]} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,strong:boolean>>")

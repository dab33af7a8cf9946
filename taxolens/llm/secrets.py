"""Secret scans: base patterns and multipart credential linking.

Base spans follow three fixed patterns. The method then collects *parts* of
credentials in each document: access identifiers, secrets and endpoints, some of
them too weak to report alone (a named account or client id, a long mixed token, a
host). An interval join within scopes (``REACH`` bytes around a part) links parts; a weak
part is reported only where a part of a complementary role stands in its scope without
overlapping it: no token is its own complement, and what an identifier covers is no
secret.

Defined cases: a null or empty text has no spans; spans are in code points, end
exclusive; spans that begin at one place are told in the order of kinds, then of ends;
repeated rows are scanned each for itself; a very long text costs time in proportion
(sorted sweeps over its parts, no pairs are listed); an empty table gives an empty one;
the struct takes the name given by ``into`` and replaces a column of that name, all
other columns stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import small_batches, utf8

# The three base patterns and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_RUN = re.compile(rb"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

#: Words that any assignment has; the pattern runs only where one occurs.
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Parts within so many bytes of each other share a scope.
REACH = 200
ID_CUES = (b"client", b"account", b"user", b"access")
WEAK_ID = re.compile(rb"(?:client|account|user|access)[_-]?(?:key[_-]?)?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{4,}", re.I)
WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(rb"https?://[A-Za-z0-9.-]+(?::\d+)?|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}", re.I)
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by the three fixed patterns."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _may_have_hex(text):
        out += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return out


_NOT_HEX = bytes(32 if chr(c) not in "0123456789abcdef" else c for c in range(256))


def _may_have_hex(text: bytes) -> bool:
    return any(len(x) >= HEX_LEAST for x in text.translate(_NOT_HEX).split())


def _mixed(token: bytes) -> bool:
    """A token is like a secret if it has digits and letters of both cases."""
    return token != token.lower() and token != token.upper() and any(48 <= c < 58 for c in token)


def weak_parts(text: bytes, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, role) of parts that alone prove nothing. No kind is
    searched for that could not be linked: all need an identifier in the text."""
    low = text.lower()
    out = []
    if b"id" in low and any(c in low for c in ID_CUES):
        out += [(m.start(), m.end(), "weak_id", "id") for m in WEAK_ID.finditer(text)]
    if not out and not any(k == "access" for *_, k in base):
        return []
    out += [(m.start(), m.end(), "weak_secret", "secret") for m in WEAK_SECRET.finditer(text) if _mixed(m.group())]
    out += [(m.start(), m.end(), "endpoint", "endpoint") for m in ENDPOINT.finditer(text)]
    return out


class Spans:
    """Spans of one role, for questions about what lies near a place."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = sorted(a for a, _ in spans), sorted(b for _, b in spans)

    def beside(self, a: int, b: int, reach: int) -> bool:
        """Is there one within ``reach`` of (a, b) that does not overlap it?"""
        before, after = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return before > 0 and self.ends[before - 1] > a - reach or after < len(self.starts) and self.starts[after] < b + reach

    def overlaps(self, a: int, b: int) -> bool:
        """Does one overlap (a, b)? As many begin before ``b`` as end by ``a`` if none does."""
        return bisect_left(self.starts, b) > bisect_right(self.ends, a)


def link(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak parts with complementary parts in scope.

    An identifier or a secret needs the other of the two; an endpoint needs both. The
    join is a sweep: for each role, starts and ends are sorted, and the nearest part on
    either side decides. Weak parts that overlap a base span are known already.
    """
    known = Spans([(a, b) for a, b, _ in base])
    ids = Spans([(a, b) for a, b, k in base if k == "access"] + [(a, b) for a, b, _, r in weak if r == "id"])
    bare = [(a, b) for a, b, k in base if k != "access"] + [(a, b) for a, b, _, r in weak if r == "secret"]
    near = {"id": ids, "secret": Spans([s for s in bare if not ids.overlaps(*s)])}
    wants = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
    out = []
    for a, b, kind, role in weak:
        if role == "secret" and ids.overlaps(a, b) or known.overlaps(a, b):
            continue
        if all(near[w].beside(a, b, reach) for w in wants[role]):
            out.append((a, b, kind))
    return out


def scan(text: bytes) -> tuple[int, int, int, str, str, int]:
    """What RESULT holds, for one text."""
    base = base_spans(text)
    weak = weak_parts(text, base)
    more = link(base, weak) if weak else []
    if base or more:
        # code points before each byte that begins or ends a span
        at, seen, before = {}, 0, 0
        for p in sorted({x for s in (*base, *more) for x in s[:2]}):
            seen += len(text[before:p].decode("utf-8", "replace"))
            at[p], before = seen, p
        said = lambda spans: ",".join(f"{k}:{at[a]}:{at[b]}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
        plain, full = said(base), said([*base, *more])
    else:
        plain = full = ""
    count = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
    return *count, hashlib.sha256(plain.encode()).hexdigest(), full, len(more)


def _scan_texts(texts: pa.Array) -> pa.Array:
    out = [scan(t) for t in utf8(texts)]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    return pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with one struct column more: counts, digest and spans."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, F.arrow_udf(_scan_texts, RESULT)(F.col(text)))

r"""Secret scans with multipart credential linking.

Three patterns find secrets that stand for themselves: assignments, access
identifiers and long hexadecimal strings.  Weak candidates, which look like
parts of a credential (identifiers, random-looking secrets, endpoints), are
reported only with their complement: parts are intervals, and an interval
join looks for a complementary part in the same scope (a passage between blank
lines), however far apart.  An identifier needs a secret, a secret needs an
identifier, an endpoint needs both.  The join runs over sorted intervals and
running ends, so it is linear after the sort and makes no pairs.

Each text is scanned whole and by itself: no shuffle.  Positions are code
points, ends exclusive.

Defined results: null and empty texts have no spans; repeated rows and null
ids are rows of their own; weak candidates that overlap a base span are that
span; spans of one start are ordered as ``KINDS``; texts of any length are
scanned whole, in time that grows with them; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "link_id", "link_secret", "link_endpoint")

_FLAGS = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{15,63}(?![A-Za-z0-9])")
#: Where a name may begin: after no letter, or as a camelCase word.
_BEGIN = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
_NAMED_ID = re.compile(_BEGIN + r"""(?:client[_-]?id|access[_-]?key(?:[_-]?id)?|user(?:[_-]?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{4,}""", _FLAGS)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
#: A scheme is tried where its run of characters begins, not at each of them.
_ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+|""" + _BEGIN + r"""(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]{3,}""", _FLAGS)
_SCOPE = re.compile(r"\n[\x20\x09\x0D]*\n")
_DIGIT, _UPPER, _LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found, low = [], text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def identifiers(text: str) -> list[Span]:
    found = [("link_id", m.start(), m.end()) for m in _ID.finditer(text) if _DIGIT.search(m[0])]
    if "=" in text or ":" in text:
        found += [("link_id", m.start(), m.end()) for m in _NAMED_ID.finditer(text)]
    return found


def keys(text: str) -> list[Span]:
    return [("link_secret", m.start(), m.end()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and _UPPER.search(m[0]) and _LOWER.search(m[0])]


def endpoints(text: str) -> list[Span]:
    return [("link_endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """The weak candidates; none where an identifier or a secret is wanting in the whole text."""
    ids = identifiers(text)
    if not ids and not any(s[0] == "access" for s in base):
        return []
    secrets = keys(text)
    if not secrets and not any(s[0] in ("assign", "hex") for s in base):
        return []
    return ids + secrets + endpoints(text)


class _Intervals:
    """Sorted intervals with running ends: says whether one meets a range."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends, last = [a for a, _ in ordered], [], -1
        for _, b in ordered:
            last = max(last, b)
            self.ends.append(last)

    def meets(self, low: int, high: int) -> bool:
        before = bisect_left(self.starts, high)
        return before > 0 and self.ends[before - 1] > low


def linked(text: str, base: list[Span], weak: list[Span]) -> list[Span]:
    """The weak candidates with complementary parts in their scope."""
    taken = _Intervals(base)
    weak = [w for w in weak if not taken.meets(w[1], w[2])]
    if not weak:
        return []
    names = _Intervals([s for s in base + weak if s[0] in ("access", "link_id")])
    secrets = _Intervals([s for s in base + weak if s[0] in ("assign", "hex", "link_secret")])
    if not names.starts or not secrets.starts:
        return []
    bounds = [0, *(m.start() for m in _SCOPE.finditer(text)), len(text)]
    out = []
    for kind, a, b in weak:
        scope = max(bisect_left(bounds, a + 1) - 1, 0)
        low, high = bounds[scope], bounds[min(scope + 1, len(bounds) - 1)]
        if (kind == "link_id" or names.meets(low, high)) and (kind == "link_secret" or secrets.meets(low, high)):
            out.append((kind, a, b))
    return out


def find_spans(text: str | None) -> list[Span]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked(text, base, weak_parts(text, base)), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None) -> str | None:
    """The text with each run of overlapping spans as ``[KIND]``."""
    out, at, end, kind = [], 0, -1, ""
    for k, a, b in find_spans(text):
        if a < end:
            end = max(end, b)
            continue
        if kind:
            out.append(f"[{kind}]")
            at = end
        out.append(text[at:a])
        at, end, kind = a, b, k.upper()
    if not kind:
        return text
    return "".join([*out, f"[{kind}]", text[end:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` (kind, start, end), one row per document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; all rows and columns stay."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    named = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))

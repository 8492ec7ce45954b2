"""Secret scan with multipart credential linking.

Strong patterns (``assign``, ``access``, ``hex``) are always reported. Weak parts, namely
identifiers (``ident``), secrets under vague labels or mixed tokens without a label (``part``) and
``endpoint`` addresses, say nothing alone. They are reported only if a complementary part lies in the
same scope: at most ``REACH`` code points away in the same block (blocks end at an empty line). An
identifier or endpoint needs a secret; a weak secret needs an identifier or endpoint. Strong spans
count as parts too. The two must be disjoint: nothing is the complement of a span that it overlaps, and a
token without a label is no part if it overlaps a labelled value or an address. Each document's
intervals are joined by sorted starts and ends, in n log n steps and without forming pairs.

Null text counts as empty and has no span. Rows are kept one for one, repeated ones too. Offsets are
code points, ends exclusive. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need

REACH = 200
KINDS = ("assign", "access", "hex", "ident", "part", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Same matches as all runs of these characters of which those under 24 are dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A label may have a prefix, as in DB_USER or aws_access_key_id.
_PREFIX = r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,32}[_-]){0,4}"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
IDENT = re.compile(_PREFIX + r"(?:(?:client|access|account|app|tenant|key)[_-]?(?:key[_-]?)?id|user(?:name)?|login)" + _SIGN + r"[\w.@+-]{3,}", re.I | re.A)
PART = re.compile(_PREFIX + r"(?:pwd|pass|passphrase|auth|bearer|credentials?|private[_-]?key|signature)" + _SIGN + r"[A-Za-z0-9+/_.=!@#$%^&*-]{4,}", re.I | re.A)
BEARER = re.compile(r"(?<![A-Za-z0-9])Bearer\x20+[A-Za-z0-9+/_.=-]{8,}", re.A)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")
URL = re.compile(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", re.A)
HOST = re.compile(_PREFIX + r"(?:host(?:name)?|endpoint|server)" + _SIGN + r"[A-Za-z0-9.-]{3,}(?::\d+)?", re.I | re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int]


def strong(text: str) -> dict[str, list[Span]]:
    """The always reported spans, by kind."""
    labelled = ASSIGN.finditer(text) if ":" in text or "=" in text else ()
    return {
        "assign": [m.span() for m in labelled if len(m[2]) >= 6],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class _Spans:
    """Spans of which no two are the same, to be asked for neighbours."""

    def __init__(self, spans: Iterable[Span]) -> None:
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], sorted(e for _, e in spans)
        self.reach = list(accumulate((e for _, e in spans), max))

    def overlap(self, lo: int, hi: int) -> bool:
        """Whether any has a code point of lo .. hi - 1."""
        k = bisect_left(self.starts, hi)
        return bool(k) and self.reach[k - 1] > lo

    def beside(self, span: Span, lo: int, hi: int) -> bool:
        """Whether any that is disjoint from ``span`` ends at ``lo`` or later, or starts at ``hi`` or earlier."""
        before, after = bisect_right(self.ends, span[0]), bisect_left(self.starts, span[1])
        return (before > 0 and self.ends[before - 1] >= lo) or (after < len(self.starts) and self.starts[after] <= hi)


def weak(text: str) -> dict[str, list[Span]]:
    """The spans that need a complement, by kind."""
    label = ":" in text or "=" in text
    found = {
        "ident": [m.span() for m in IDENT.finditer(text)] if label else [],
        "part": ([m.span() for m in PART.finditer(text)] if label else []) + ([m.span() for m in BEARER.finditer(text)] if "Bearer" in text else []),
        "endpoint": ([m.span() for m in URL.finditer(text)] if "://" in text else []) + ([m.span() for m in HOST.finditer(text)] if label else []),
    }
    mixed = [m.span() for m in MIXED.finditer(text) if _mixed(m[0])]
    if mixed:
        labelled = _Spans(s for v in found.values() for s in v)
        found["part"] += [s for s in mixed if not labelled.overlap(*s)]
    return found


def link(text: str, sure: dict[str, list[Span]], loose: dict[str, list[Span]], reach: int = REACH) -> dict[str, list[Span]]:
    """Those of the weak spans that have a complement in scope and overlap no strong span."""
    taken = _Spans(s for spans in sure.values() for s in spans)
    loose = {k: sorted({s for s in v if not taken.overlap(*s)}) for k, v in loose.items()}
    if not any(loose.values()):
        return loose
    cuts = [0, *(m.end() for m in BLANK.finditer(text)), len(text) + 1]
    secret = _Spans(sure["assign"] + sure["hex"] + loose["part"])
    other = _Spans(sure["access"] + loose["ident"] + loose["endpoint"])

    def near(span: Span, partners: _Spans) -> bool:
        block = bisect_right(cuts, span[0])
        return partners.beside(span, max(span[0] - reach, cuts[block - 1]), min(span[1] + reach, cuts[block] - 1))

    return {k: [s for s in v if near(s, other if k == "part" else secret)] for k, v in loose.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by start, then kind in the order of ``KINDS``, comma-joined."""
    flat = sorted((s, KINDS.index(k), e) for k, v in spans.items() for s, e in v)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in flat)


def scan(text: str | None, reach: int = REACH) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Strong spans, and weak spans that are linked."""
    text = text or ""
    sure = strong(text)
    return sure, link(text, sure, weak(text), reach)


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``(doc_id, base, spans, counts)`` a row: both span lists as text, and counts by kind."""
    rows = need(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                sure, linked = scan(text, reach)
                both = sure | linked
                out.append((joined(sure), joined(both), *(len(both[k]) for k in KINDS)))
            yield pd.concat([pdf[["doc_id"]], pd.DataFrame(out, columns=["base", "spans", *(f"n_{k}" for k in KINDS)], index=pdf.index)], axis=1)

    return rows.mapInPandas(run, f"doc_id {kind}, base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS))


def redacted(text: str | None, reach: int = REACH, mask: str = "[REDACTED]") -> str | None:
    """``text`` with every reported span, overlapping ones together, replaced by ``mask``."""
    if not text:
        return text
    sure, linked = scan(text, reach)
    spans, out, at = sorted(s for v in (*sure.values(), *linked.values()) for s in v), [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redact_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with all rows and columns, secrets in ``text`` masked and ``n_chars`` counted anew."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, reach))

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's result over the whole ``documents`` table."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_ident", "n_part", "n_endpoint")

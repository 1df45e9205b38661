"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Two sets of spans per text. The base set has e-mail and IPv4 addresses, payment
cards (16 to 19 digits, Luhn) and international phone numbers, leftmost and not
overlapping per kind. The method adds bank account numbers (IBAN, mod 97), cards
of 13 to 15 digits, national phone and social security numbers: each starts with
a score of its pattern, gains a confirmed checksum and words of context within
``CONTEXT`` code points, and is kept from ``THRESHOLD`` on. Base spans always stay;
added spans that overlap a base span or a better one are left out.

Offsets are code points, ends exclusive. Scanning time is linear in the text:
patterns are possessive or anchored at a character they need.

Defined cases: NULL and empty text has no spans; rows are kept one to one, repeated
and NULL ids included; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from haberdash.llm.tables import table

CONTEXT = 48
THRESHOLD = 0.6
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card", "local_phone", "ssn")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

# Words that speak for a kind.
_WORDS = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "short_card": ("card", "credit", "visa", "amex", "karte", "carte", "tarjeta"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appelez"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
_PATTERN_SCORE = {"iban": 0.3, "short_card": 0.2, "local_phone": 0.5, "ssn": 0.4}
_CHECKSUM_SCORE = 0.4
_CONTEXT_SCORE = 0.3


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float = 1.0


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, blanks removed, has the remainder 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[Span]:
    over = 0
    for found in _DOMAIN.finditer(text):
        start = at = found.start()
        while start > over and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at:
            over = found.end()
            yield Span("email", start, over)


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind and start."""
    spans = list(_emails(text)) if "@" in text else []
    if "." in text:
        spans += [Span("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append(Span("phone", m.start(), m.end()))
    return spans


def _proposed(text: str) -> Iterator[tuple[Span, bool]]:
    """Candidates of the added kinds, and whether a checksum confirms them."""
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield Span("iban", m.start(), m.end()), True
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 15 and luhn(digits):
                yield Span("short_card", m.start(), m.end()), True
    for m in _LOCAL_PHONE.finditer(text):
        yield Span("local_phone", m.start(), m.end()), False
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield Span("ssn", m.start(), m.end()), False


def added_spans(text: str, base: list[Span], threshold: float = THRESHOLD) -> list[Span]:
    """Scored spans of the added kinds, by start, apart from base spans and each other."""
    scored = []
    for span, confirmed in _proposed(text):
        near = text[max(0, span.start - CONTEXT) : span.end + CONTEXT].lower()
        score = _PATTERN_SCORE[span.kind] + _CHECKSUM_SCORE * confirmed
        score += _CONTEXT_SCORE * any(word in near for word in _WORDS[span.kind])
        if score >= threshold:
            scored.append(Span(span.kind, span.start, span.end, min(1.0, score)))
    kept: list[Span] = []
    # A mark for each code point, so that any number of spans takes time in proportion to the text.
    taken = bytearray(len(text) if scored else 0)
    for span in base if scored else ():
        taken[span.start : span.end] = b"\1" * (span.end - span.start)
    for span in sorted(scored, key=lambda s: (-s.score, s.start, ADDED_KINDS.index(s.kind))):
        if taken.find(1, span.start, span.end) < 0:
            kept.append(span)
            taken[span.start : span.end] = b"\1" * (span.end - span.start)
    return sorted(kept, key=lambda s: (ADDED_KINDS.index(s.kind), s.start))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at : span.start], f"[{span.kind}]"]
            at = span.end
    return "".join([*out, text[at:]])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_FOUND = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in BASE_KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("max_score", pa.float64())]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            added = added_spans(text, base)
            rows.append(
                [sum(s.kind == k for s in base) for k in BASE_KINDS]
                + [hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + added)]
                + [max((s.score for s in base + added), default=0.0)]
            )
        columns = [batch.column(0).cast(pa.int64())]
        columns += [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_FOUND)[1:])]
        yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of base spans, all spans, best score."""
    return docs.select("doc_id", "text").mapInArrow(
        _find,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double",
    )


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced by kinds; all columns kept."""
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                texts.append(text and redact(text, base + added_spans(text, base)))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents")).drop("max_score")

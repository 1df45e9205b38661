from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from rows import by_id, documents

from haberdash.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    double = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if passes(kind, m[0])
    ]


PIECES = st.sampled_from(
    ["a@b.co", "@", ".", "x", "1.2.3.4", "256", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+", "é",
     " ", "-", "0", "7", "(", ")", "a.b@c-d.e.f", "%", "1.2.3.4.5.6.7.8", "00255"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert [(s.kind, s.start, s.end) for s in pii.base_spans(text)] == brute(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


def test_added_spans_need_a_checksum_or_context():
    def kinds(text):
        return [s.kind for s in pii.added_spans(text, pii.base_spans(text))]

    assert kinds("transfer to DE89 3704 0044 0532 0130 00 today") == ["iban"]
    assert kinds("transfer to DE88 3704 0044 0532 0130 00 today") == []
    assert kinds("call 555-867-5309 now") == ["local_phone"]
    assert kinds("part 555-867-5309 now") == []
    assert kinds("her ssn is 078-05-1120") == ["ssn"]
    assert kinds("the ssn 666-05-1120 or 078-00-1120") == []
    assert kinds("amex card 378282246310005") == ["short_card"]


def test_time_is_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000, "AB12" * 50_000):
        pii.added_spans(text, pii.base_spans(text))


def test_rows(spark):
    texts = [None, "", "mail a@b.co, 1.2.3.4 and +1 (988) 555-2485 é 4111 1111 1111 1111", "x" * 100_000, "a@b.co"]
    found = pii.personal_data(documents(spark, texts, [1, None, 3, 4, 3])).collect()
    assert [r["doc_id"] for r in found] == [1, None, 3, 4, 3]
    assert [found[2][f"n_{k}"] for k in pii.BASE_KINDS] == [1, 1, 1, 1]
    written = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[2]))
    assert found[2]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
    assert found[2]["spans"] == written
    assert found[0]["spans"] == "" and found[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_redaction_keeps_columns(spark):
    docs = documents(spark, ["write to a@b.co!", None])
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    assert [r["text"] for r in clean.orderBy("doc_id").collect()] == ["write to [email]!", None]


def test_production_query_reads_everything(spark):
    from haberdash.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = by_id(QUERIES["op2_pii"](spark, folder))
    assert found.keys() == texts.keys()
    for i, row in found.items():
        spans = brute(texts[i] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]


def test_time_of_added_spans_is_linear():
    import time

    text = " ".join(f"call 555-{n % 900 + 100}-{n % 9000 + 1000}" for n in range(100_000))
    began = time.perf_counter()
    found = pii.added_spans(text, pii.base_spans(text))
    assert time.perf_counter() - began < 10
    assert len(found) == 100_000

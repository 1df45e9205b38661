"""Small awkward tables and plain reference computations for the corpus operators."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, sid int, score string"


def documents(spark, texts, ids=None):
    """A documents table with columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{n % 3}" if n % 4 else None, None, "x", 1, "y") for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCUMENTS)


def by_id(frame, key="doc_id"):
    return {r[key]: r.asDict() for r in frame.collect()}

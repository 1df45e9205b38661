from __future__ import annotations

import random

import pyarrow as pa
import pytest
from rows import documents

from haberdash.llm import decontaminate as clean


def tables(spark):
    rng = random.Random(3)
    item = [" ".join(f"q{rng.randrange(50)}" for _ in range(n)) for n in (30, 13, 5, 1, 0)]
    benchmark = spark.createDataFrame(
        [*enumerate(item), (1, item[1]), (None, "only null item"), (7, None)], "item_id long, text string"
    )
    filler = [" ".join(f"d{rng.randrange(500)}" for _ in range(60)) for _ in range(8)]
    texts = [
        *filler[:3],
        f"{filler[3]} {item[0].upper()} tail",
        f"{filler[4]}\n{item[1]}, {item[2]}",
        f"{filler[5]} only-null ITEM",
        " ".join(item[0].split()[:12]) + " cut",
        item[0],
        None,
        "",
        "... ,,,",
        f"{filler[6]} {item[3]}",
    ]
    return documents(spark, texts), benchmark, item


def values(frame):
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["spans"])) for r in frame.collect())


def test_both_forms_agree(spark):
    docs, benchmark, _ = tables(spark)
    for items in (benchmark, benchmark.selectExpr("concat('task/', item_id) AS item_id", "text", "1 AS phrase")):
        plain = clean.findings(docs, items)
        other = clean.findings(docs, items, max_windows=0)
        assert other.schema.names == plain.schema.names and values(other) == values(plain)
        assert any(r[4] for r in values(other))


def test_windows_of_equal_hash_are_told_by_their_words():
    windows = [{"at": 2, "size": 2, "number": 7, "phrase": "b c"}, {"at": 2, "size": 2, "number": 8, "phrase": "b x"}]
    near = pa.array([windows, None])
    found = list(clean._verified(pa.array(["é A, B\nC d", None]), near))
    assert found == [(5, 2, [7], [{"first": 5, "last": 8}]), (0, 0, [], [])]


def test_hits(spark):
    docs, benchmark, item = tables(spark)
    found = {r[0]: r[1:] for r in values(clean.findings(docs, benchmark))}
    assert found[3][0] == 91 and found[3][1] >= 30 and "0" in found[3][2]
    assert found[4][2][0] == "1" and found[5][1] == 3 and found[5][2] == ()
    assert found[7][1] == found[7][0] == 30
    assert found[8] == found[9] == found[10] == (0, 0, (), ())


@pytest.mark.parametrize("most", [clean.MAX_BROADCAST_WINDOWS, 0])
def test_contaminated_documents_go(spark, most):
    docs, benchmark, _ = tables(spark)
    bad = {r["doc_id"] for r in clean.judged(clean.findings(docs, benchmark)).where("contaminated").collect()}
    kept = clean.decontaminate(docs, benchmark, max_windows=most)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(12)) - bad
    assert {3, 4, 7} <= bad and not bad & {0, 1, 2, 8, 9, 10}


@pytest.mark.parametrize("most", [clean.MAX_BROADCAST_WINDOWS, 0])
def test_spans_are_cut(spark, most):
    texts = ["é keep one two three keep", "keep", None, "", "one two three " * 3000 + "end"]
    # Further columns may bear the names used inside.
    docs = documents(spark, texts).selectExpr("doc_id AS row", "7 AS near", "text", "doc_id", "'x' AS c0")
    benchmark = spark.createDataFrame([("a-1", "one, TWO three"), (None, "")], "item_id string, text string")
    found = clean.decontaminate(docs, benchmark, spans=True, max_windows=most)
    assert found.columns == docs.columns
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == ["é keep  keep", "keep", None, "", " end"]
    assert [(r["row"], r["near"], r["c0"]) for r in rows] == [(i, 7, "x") for i in range(5)]


def test_empty_tables(spark):
    docs, benchmark, _ = tables(spark)
    assert clean.findings(docs.limit(0), benchmark).count() == 0
    assert clean.findings(docs.limit(0), benchmark, max_windows=0).count() == 0
    assert clean.decontaminate(docs, benchmark.limit(0), spans=True, max_windows=-1).count() == 12
    for most in (clean.MAX_BROADCAST_WINDOWS, -1):
        rows = clean.findings(docs, benchmark.limit(0), max_windows=most).collect()
        assert len(rows) == 12 and all(r["n_hit"] == 0 and not r["items"] for r in rows)

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from rows import by_id, documents

from haberdash.llm import substring_dedup as dedup
from haberdash.llm.words import slices, split_words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, ids, size):
    """Places to remove of each text, by plain comparison of all windows."""
    first = defaultdict(lambda: None)
    for text, i in zip(texts, ids):
        words = split(text)
        for k in range(len(words) - size + 1) if i is not None else ():
            window = tuple(words[k : k + size])
            first[window] = i if first[window] is None else min(first[window], i)
    gone = []
    for text, i in zip(texts, ids):
        words = split(text)
        places = set()
        for k in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[k : k + size])] < i:
                places.update(range(k, k + size))
        gone.append(places)
    return gone


def corpus(rng, n, vocabulary=400):
    pool = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(8, 90))] for _ in range(10)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(5, 60)]
            words += [f"{rng.choice('Wv')}{rng.randrange(vocabulary)}" for _ in range(rng.randrange(6))]
        texts.append("".join(w + rng.choice([" ", "\n", " \t"]) for w in words))
    return texts


@pytest.mark.parametrize("size", [13, 5, 30])
def test_removed_words_equal_brute_force(spark, size):
    rng = random.Random(size)
    texts = corpus(rng, 150) + [None, "", " \n", "Über Größe " * 40, "Über Größe " * 40]
    ids = rng.sample(range(1000), len(texts))
    found = by_id(dedup.with_spans(documents(spark, texts, ids), size))
    assert len(found) == len(texts)
    for text, i, gone in zip(texts, ids, brute(texts, ids, size)):
        spans = found[i]["spans"] or []
        assert {k for s in spans for k in range(s["first"], s["last"])} == gone
        assert all(a["last"] < b["first"] for a, b in zip(spans, spans[1:]))
    cut = by_id(dedup.without_repeats(documents(spark, texts, ids), size))
    for text, i, gone in zip(texts, ids, brute(texts, ids, size)):
        expected = " ".join(w for k, w in enumerate(split(text)) if k not in gone) if gone else text
        assert cut[i]["text"] == expected


def test_digests(spark, tmp_path):
    rng = random.Random(2)
    texts = corpus(rng, 80) + [None, ""]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(dedup.op11_substring_dedup(spark, str(tmp_path)))
    for i, (text, gone) in enumerate(zip(texts, brute(texts, range(82), 13))):
        words = split(text)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        digest = hashlib.sha256(kept.encode()).hexdigest()
        assert found[i] == {"doc_id": i, "n_words": len(words), "n_removed": len(gone), "kept_sha256": digest}


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(3)
    long = " ".join(f"x{rng.randrange(9999)}" for _ in range(300))
    texts = [long if n % 3 == 0 else " ".join(f"y{rng.randrange(9**6)}" for _ in range(30)) for n in range(300)]
    found = by_id(dedup.without_repeats(documents(spark, texts)))
    assert [n for n in range(300) if found[n]["text"] == ""] == list(range(3, 300, 3))
    assert all(found[n]["text"] == texts[n] for n in range(300) if n % 3 or not n)


def test_awkward_rows(spark):
    text = " ".join(f"a{n}" for n in range(20))
    docs = documents(spark, [text, text, text, text, None], [None, 7, 7, 9, 9])
    rows = sorted((r["doc_id"] or -1, r["text"] or "") for r in dedup.without_repeats(docs).collect())
    # Rows with one id take nothing from each other, those without an id from nobody.
    assert rows == [(-1, text), (7, text), (7, text), (9, ""), (9, "")]
    assert dedup.without_repeats(docs).columns == docs.columns
    assert dedup.with_spans(documents(spark, [])).count() == 0
    named = spark.createDataFrame([("b", text, 1, "p"), ("a", text, 2, "q")], "doc_id string, text string, row int, hash string")
    assert by_id(dedup.without_repeats(named))["b"]["text"] == ""
    long = " ".join(f"b{n % 50_000}" for n in range(100_000))
    found = by_id(dedup.with_spans(documents(spark, [long, "c " + long])))
    assert found[0]["spans"] is None and found[1]["spans"][0].asDict() == {"first": 1, "last": 100_001}


def test_short_levels_choose_a_superset():
    rng = random.Random(4)
    texts = corpus(rng, 40)
    assert dedup.lengths(13) == [7, 13] and dedup.lengths(50) == [7, 13, 25, 50] and dedup.lengths(5) == [5]
    chosen = defaultdict(set)
    for row, _, data, offsets in slices(pa.array(texts)):
        words = split_words(data, offsets, lower=False)
        at = dedup._starts(words, 13)
        least = dedup.representatives(words, at, 7, 13)
        for start, value in zip(at.tolist(), least.tolist()):
            end = start + 12
            chosen[bytes(words.data[words.start[start] : words.end[end]]).replace(b"\t", b" ").split().__repr__()].add(value)
        assert len(np.unique(least)) < len(least)
    # Equal windows have one representative.
    assert all(len(values) == 1 for values in chosen.values())


def test_doubling_goes_on_until_none_survive(spark):
    rng = random.Random(5)
    texts = corpus(rng, 60)
    ids = list(range(60))
    found = {r["doc_id"]: r["words"] for r in dedup.longest(documents(spark, texts)).collect()}
    expected = {}
    size = 13
    while True:
        holders = defaultdict(set)
        for text, i in zip(texts, ids):
            words = split(text)
            for k in range(len(words) - size + 1):
                holders[tuple(words[k : k + size])].add(i)
        alive = {i for some in holders.values() if len(some) > 1 for i in some}
        if not alive:
            break
        expected |= dict.fromkeys(alive, size)
        size *= 2
    assert found == expected and size > 26

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from rows import LOWER, by_id, documents

from haberdash.llm import spelling


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words):
    out = {}
    shared = defaultdict(set)
    for w in words:
        # Words within one edit are equal after at most one deletion each.
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shared[v].add(w)
    for w, n in words.items():
        around = {o for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for o in shared[v] if near(w, o)}
        best = min(around, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = {"word": w, "form": form, "n": n, "n_near": len(around), "form_n": words[form] if form else None}
    for w in out:
        root = w
        while out[root]["form"] is not None:
            root = out[root]["form"]
        out[w]["root"] = root
    return out


def made(rng, n, alphabet="abcé", lengths=(7, 14)):
    """Words, their near misses, and how often each occurs."""
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(*lengths)))
        words[w] = rng.choice([2, 3, 30, 300, 4000])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
            if len(w) >= 7:
                words[w] = rng.choice([2, 3, 30, 300])
    return words


@pytest.mark.parametrize("most", [20_000, 40, 3])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgéÿ"])
def test_variants_equal_brute_force(spark, monkeypatch, most, alphabet):
    monkeypatch.setattr(spelling, "RANGE", most)
    monkeypatch.setattr(spelling, "CHUNK", 100)
    rng = random.Random(most)
    words = made(rng, 500, alphabet)
    found = by_id(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")), "word")
    assert found == brute(words)
    assert any(r["form"] and r["root"] != r["form"] for r in found.values())


def test_a_third_of_the_words_share_a_beginning(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE", 50)
    rng = random.Random(4)
    words = made(rng, 300)
    words |= {"commonstart" + w: n for w, n in list(words.items())[:150]}
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(
        spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if near(a, b)}


def test_documents_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    pool = list(made(rng, 120, "abcdeÀé"))
    texts = [" ".join(rng.choice(pool).title() + rng.choice(["", ".", "1", "×"]) for _ in range(200)) for _ in range(60)]
    rows = list(enumerate([*texts, None, "", "short words", "commonword " * 5000])) + [(7, texts[7]), (None, texts[3])]
    frame = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(spelling.op12_spelling(spark, str(tmp_path)), "word")
    assert found == brute(brute_words(rows))
    assert any(r["form"] for r in found.values())


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert by_id(spelling.op12_spelling(spark, folder), "word") == brute(brute_words(rows))


def test_empty(spark):
    found = spelling.variants(spelling.vocabulary(documents(spark, [])))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.count() == 0


def test_rows_of_a_list_share_prefixes():
    texts = ["aaa", "aab", "abb", "abb", "b"]
    letters = np.zeros((5, 4), np.uint32)
    for i, t in enumerate(texts):
        letters[i, : len(t)] = [ord(c) for c in t]
    assert spelling.common_prefixes(letters, np.array([1, 1, 1, 2, 2])).tolist() == [-1, 2, 1, -1, 0]

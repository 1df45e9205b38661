from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import by_id, documents, words

from haberdash.llm import katz

END = object()


def plain_discounts(counts):
    n = Counter(c for c in counts if c)
    d = {}
    common = (katz.K + 1) * n[katz.K + 1] / n[1] if n[1] else 1.0
    steady = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    for r in range(1, katz.K + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        d[r] = (ratio - common) / (1 - common) if common < 1 else -1
        if not 0 < d[r] < 1:
            d[r] = max(0.0, r - min(steady, 0.999)) / r
    return d


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for text in texts:
            tokens = [*words(text), END]
            self.one.update(tokens)
            self.two.update(zip([END, *tokens], tokens))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = plain_discounts(self.one.values()), plain_discounts(self.two.values())
        self.left = 1 - sum(self.d1.get(c, 1) * c for c in self.one.values()) / self.n if self.n else 0
        self.after = defaultdict(dict)
        for (h, w), c in self.two.items():
            self.after[h][w] = c

    def base(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def single(self, w):
        if not self.left > 1e-15:
            return self.base(w)
        return self.d1.get(self.one[w], 1) * self.one[w] / self.n if self.one[w] else self.left

    def pair(self, h, w):
        if h not in self.after:
            return self.single(w)
        seen = self.after[h]
        whole = self.one[h]
        mass = sum((1 - self.d2.get(c, 1)) * c for c in seen.values())
        if not any(c <= katz.K for c in seen.values()):
            mass, whole = 1, whole + 1
        if w in seen:
            return self.d2.get(seen[w], 1) * seen[w] / whole
        return mass / whole / max(1 - sum(self.single(x) for x in seen), 1e-12) * self.single(w)

    def score(self, text):
        tokens = [*words(text), END]
        return sum(math.log10(self.pair(h, w)) for h, w in zip([END, *tokens], tokens))


def corpus(seed, many):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60))) for _ in range(many)]
    return [t + f" rare{n}" if n % 9 == 0 else t for n, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [(katz.CHUNK_TOKENS, katz.BUCKET_TOKENS), (300, 400)])
def test_scores_equal_a_plain_model(spark, sizes):
    texts = [*corpus(1, 200), None, "", "A b  a\tB"]
    docs = documents(spark, texts).withColumn("held_out", F.col("doc_id") % 7 == 2).repartition(3)
    found = by_id(katz.scores(docs, *sizes))
    model = Plain([t for i, t in enumerate(texts) if i % 7 != 2])
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        row, tokens = found[i], [*words(text), END]
        assert row["n_tokens"] == len(tokens) and row["train_tokens"] == model.n
        assert row["n_known"] == sum(model.one[w] > 0 for w in tokens)
        assert row["base_score"] == pytest.approx(sum(math.log10(model.base(w)) for w in tokens), rel=1e-9)
        assert row["score"] == pytest.approx(model.score(text), rel=1e-9)


def test_probabilities_add_up_to_one():
    model = Plain(corpus(2, 80))
    for h in [END, "w0", "w5", "w150", "never seen"]:
        total = sum(model.pair(h, w) for w in model.one) + model.pair(h, "unknown")
        assert total == pytest.approx(1)


def test_held_out_rule(spark):
    folder = "/root/testdata/sf0.001"
    found = by_id(katz.op4_katz(spark, folder))
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    better = [r["score"] > r["base_score"] for r in found.values() if r["held_out"]]
    assert sum(better) > 0.8 * len(better)


def test_awkward_rows(spark):
    docs = documents(spark, ["a b", "a b", None], [1, 1, None]).withColumn("held_out", F.lit(False))
    rows = katz.scores(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 3, 3]
    assert katz.scores(documents(spark, []).withColumn("held_out", F.lit(False))).count() == 0
    nothing = documents(spark, ["a b"]).withColumn("held_out", F.lit(True))
    row = katz.scores(nothing).first()
    assert row["train_tokens"] == 0 and row["score"] == row["base_score"] == 0


def test_packing():
    for values in (np.arange(1000, dtype=np.uint32), np.zeros(0, np.int64), np.array([True, False])):
        assert np.array_equal(katz.unpack(katz.pack(values)), values)
    a, b = katz.unpack_all(katz.pack_all(np.arange(3), np.ones(2)))
    assert a.tolist() == [0, 1, 2] and b.tolist() == [1, 1]

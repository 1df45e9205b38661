from __future__ import annotations

import random

import pytest
from rows import documents

from haberdash.llm import mixing


def planned(spark, known, blocks):
    rows = [(source, weight) for source, weight in known]
    sources = mixing.units(spark.createDataFrame(rows, "source string, weight double"))
    counts = spark.createDataFrame([(s, blocks[s]) for s, _ in known], "source string, blocks long")
    return mixing.schedule(sources.join(counts, "source")).orderBy("slot").collect()


@pytest.mark.parametrize("seed", range(4))
def test_no_source_is_a_block_ahead_or_behind_its_weight(spark, seed):
    rng = random.Random(seed)
    known = [(f"s{i}", rng.random() ** 3 + 1e-6) for i in range(rng.choice([1, 2, 7, 20]))]
    blocks = {s: rng.randrange(1, 60) for s, _ in known}
    plan = planned(spark, known, blocks)
    assert [r["slot"] for r in plan] == list(range(sum(blocks.values())))
    done, start, weight = {s: 0 for s, _ in known}, {s: 0 for s, _ in known}, dict(known)
    since = 0
    for n, row in enumerate(plan):
        assert row["release"] <= n < row["deadline"] and row["block"] == done[row["source"]]
        assert row["on_target"] == (since == 0)
        done[row["source"]] += 1
        total = sum(weight.values())
        for source in weight:
            # Against the weights themselves, from the slot on at which the last source ran out.
            ideal = (n + 1 - since) * weight[source] / total
            assert abs(done[source] - start[source] - ideal) < 1 + 1e-6
        if done[row["source"]] == blocks[row["source"]]:
            del weight[row["source"]]
            since, start = n + 1, dict(done)
    assert done == blocks


def test_many_sources(spark):
    known = [(f"s{i}", 1.0 + i % 7) for i in range(500)]
    plan = planned(spark, known, {s: 2 for s, _ in known})
    assert len(plan) == 1000 and {(r["source"], r["block"]) for r in plan} == {(s, k) for s, _ in known for k in (0, 1)}


def test_units_follow_weights(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0), ("d", 1e-30), (None, 4.0)], "source string, weight double")
    got = {r["source"]: r["units"] for r in mixing.units(rows).collect()}
    assert got == {"a": mixing.UNITS * 3 // 8, "b": mixing.UNITS // 8, "d": 1, None: mixing.UNITS // 2}


def test_every_document_has_its_block(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(0, 400) for _ in range(200)] + [None, "", "y" * 100_000]
    docs = documents(spark, texts)
    found = mixing.mix(docs, slots=50).collect()
    size = -(-sum(len(t or "") for t in texts) // 50)
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert all(r["source"] == sources[r["doc_id"]] for r in found)
    of_slot = {}
    for r in found:
        assert 0 <= r["place"] < size and r["chars"] == len(texts[r["doc_id"]] or "")
        assert of_slot.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        assert r["release"] <= r["slot"] < r["deadline"]
    for source in set(sources.values()):
        own = sorted((r["block"], r["place"], r["chars"]) for r in found if r["source"] == source)
        assert all(a[0] * size + a[1] + a[2] == b[0] * size + b[1] for a, b in zip(own, own[1:]))


def test_given_weights_and_awkward_rows(spark):
    docs = documents(spark, ["aa", "bb", "cc", "dd", "ee"], [1, 1, None, None, 2])
    found = mixing.mix(docs, weights={"s1": 1.0, "s2": 2.0}, slots=10).collect()
    assert len(found) == 5
    assert all((r["slot"] is None) == (r["source"] not in ("s1", "s2")) for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_only_native_operators(spark):
    docs = documents(spark, ["aa", "bb"])
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert "NestedLoop" not in plan

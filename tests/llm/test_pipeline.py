"""The pipeline, stage by stage, each against a plain form on its own input."""

from __future__ import annotations

import random

from rows import documents
from test_jaccard_join import brute

import corpus_pipeline
from haberdash.llm import decontaminate as clean
from haberdash.llm.jaccard_join import NEAR


def prose(rng, n):
    return " ".join(f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(n))


def tables(spark, folder):
    rng = random.Random(11)
    bad = ["foozle", "grumbot", "snarkle", "blatherskite"]
    items = [prose(rng, 20) for _ in range(4)]
    passage = prose(rng, 70)
    texts, toxic = [], set()
    for n in range(300):
        text = prose(rng, rng.randrange(30, 120))
        if n % 5 == 0:
            words = text.split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            text = " ".join(words)
            toxic.add(n)
        elif n % 11 == 0:
            text += f" {passage} {prose(rng, 10)}"
        elif n % 13 == 0:
            text += " " + items[n % 4]
        elif n % 17 == 0:
            text = texts[n - 1]
        elif n % 19 == 0:
            text = " ".join(w for w in texts[n - 1].split()[:30]) + " end"
        texts.append(text)
    documents(spark, [*texts, None, ""]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(n, 1, int(n in toxic)) for n in range(300)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return toxic, passage, texts


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    toxic, passage, texts = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if name != "mixing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert len(set(kept[name]) & toxic) < 0.2 * len(toxic)
            assert len(set(before) - set(kept[name]) - toxic) < 0.05 * len(texts)
        if name == "line_dedup":
            assert sum(passage in (t or "") for t in kept[name].values()) == 1
            assert all(kept[name].get(i) == t for i, t in before.items() if i in (1, 2, 3, 300, 301))
        if name == "jaccard_join":
            group = brute(sorted(before.items()), NEAR)
            assert set(kept[name]) == {i for i, (_, least) in group.items() if least == i}
        if name == "benchmark_decontamination":
            benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
            rows = documents(spark, list(before.values()), list(before))
            bad = {r["doc_id"] for r in clean.judged(clean._joined(clean._numbered(rows), benchmark)).where("contaminated").collect()}
            assert bad and set(kept[name]) == set(before) - bad
        if name == "mixing":
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(before)


def test_run_equals_the_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(docs.collect(), key=repr) == sorted(corpus_pipeline.run(spark, folder).collect(), key=repr)

from __future__ import annotations

import random
import zlib

import pytest
from rows import documents

from haberdash.llm import toxicity as tox


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    plain = [f"{rng.choice(['lor', 'em', 'ips', 'dol'])}{rng.choice(['um', 'or', 'et', 'at'])}{i}" for i in range(300)]
    bad = ["foozle", "grumbot", "snarkle", "blatherskite"]
    out = []
    for n in range(600):
        text = rng.choices(plain, k=rng.randrange(40, 200))
        if n % 4 == 0:
            for _ in range(1 + len(text) // 20):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        out.append((n, " ".join(text), int(n % 4 == 0)))
    return out


def test_held_out_documents_are_told_apart(spark, rows):
    docs = documents(spark, [t for _, t, _ in rows])
    model = tox.fit(docs, labels(spark, [(i, 1, y, 0.0) for i, _, y in rows]))
    found = {r["doc_id"]: r for r in tox.scored(docs, model).collect()}
    right = [found[i]["predicted"] == y for i, _, y in rows if found[i]["held_out"]]
    assert sum(right) > 0.9 * len(right)
    for i, _, _ in rows:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= found[i]["score"] <= 1 and found[i]["predicted"] == (found[i]["score"] >= 0.5)
    kept = tox.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}


def test_held_out_labels_teach_nothing(spark, rows):
    docs = documents(spark, [t for _, t, _ in rows])
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 0.0) for i, _, y in rows]
    true = [(i, 1, y, 0.0) for i, _, y in rows]
    one, two = (tox.scored(docs, tox.fit(docs, labels(spark, x))).collect() for x in (true, flipped))
    assert [r["score"] for r in one] == [r["score"] for r in two]


def test_awkward_rows(spark, rows):
    long = "word " * 20_000
    docs = documents(spark, ["a", "", None, long, "a"], [1, 2, 3, None, 1])
    known = labels(spark, [(1, 1, 1, 0.0), (1, 1, 0, 0.0), (None, 1, 1, 0.0), (2, 1, None, 0.0), (99, 1, 0, 0.0)])
    found = tox.scored(docs, tox.fit(docs, known)).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    model = tox.fit(docs, known.limit(0))
    assert all(r["score"] == 0 for r in tox.scored(docs, model).collect())
    assert tox.scored(docs.limit(0), model).count() == 0
    trained = tox.fit(documents(spark, [t for _, t, _ in rows]), labels(spark, [(i, 1, y, 0.0) for i, _, y in rows]))
    scores = [r["score"] for r in tox.scored(docs, trained).collect()]
    assert scores[1] == scores[2] and max(scores) < 0.5


def test_accuracy_on_the_given_tables(spark):
    """Under 400 toxic rows teach here; tables with thousands reach 0.99 (README)."""
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in tox.op7_toxicity(spark, folder).collect()}
    truth = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(found[r["doc_id"]]["score"], r["toxic"]) for r in truth if found[r["doc_id"]]["held_out"]]
    bad, good = ([s for s, y in held if y == k] for k in (1, 0))
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert above > 0.85 * len(bad) * len(good)


def test_long_texts_teach_as_a_whole(spark, rows):
    """What is toxic may stand far behind the start of a text; one copy of an id is read."""
    clean = " ".join(t for _, t, y in rows[:40] if not y)
    texts = [f"{clean} {t}" if y else t for _, t, y in rows]
    known = labels(spark, [(i, 1, y, 0.0) for i, _, y in rows])
    docs = documents(spark, texts + [texts[1]] * 50, [*range(600), *[1] * 50])
    model = tox.fit(docs, known)
    assert any(word.encode() in model.toxic for word in ("foozle", "grumbot", "snarkle", "blatherskite"))
    found = {r["doc_id"]: r for r in tox.scored(docs, model).collect()}
    caught = [found[i]["predicted"] for i, _, y in rows if y and found[i]["held_out"]]
    assert sum(caught) > 0.9 * len(caught)


def test_the_score_is_the_bytes_saved(spark, rows):
    """Features follow from compressing each window with either dictionary, done here anew."""
    import zstandard

    docs = documents(spark, [t for _, t, _ in rows])
    model = tox.fit(docs, labels(spark, [(i, 1, y, 0.0) for i, _, y in rows]))
    params = dict(source_size=256, dict_size=tox.ORDINARY_BYTES + tox.TOXIC_BYTES, min_match=4,
                  write_checksum=0, write_content_size=0, write_dict_id=0)
    params = zstandard.ZstdCompressionParameters.from_level(tox.LEVEL, **params)

    def size(content, window):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(window))

    model.open()
    for _, text, _ in rows[:12]:
        words = text.lower().split()
        cut = [f" {' '.join(words[i : i + 32])} ".encode() for i in range(0, len(words), 32)]
        saved = [size(model.ordinary, w) - size(model.toxic + model.ordinary, w) for w in cut]
        assert model.features(text)[0] == max(saved)
        assert model.features(text)[2] == pytest.approx(sum(saved) / len(saved))

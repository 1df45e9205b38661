from __future__ import annotations

import random

import numpy as np
import pytest
from rows import by_id, documents

from haberdash.llm import line_dedup as dedup
from haberdash.llm import tables


def prose(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(5000)}{rng.choice(['', '.', ','])}" for _ in range(n)]


@pytest.mark.parametrize("most", [tables.MAX_BROADCAST_ROWS, -1])
def test_repeated_passages_go_from_later_documents(spark, most, monkeypatch):
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", most)
    rng = random.Random(5)
    passages = [" ".join(prose(rng, n)) for n in (51, 55, 80, 200)]
    texts, own = [], []
    for n in range(60):
        head, tail = " ".join(prose(rng, rng.randrange(0, 40))), " ".join(prose(rng, 30))
        own.append((head, tail))
        texts.append(f"{head}{rng.choice([' ', chr(10)])}{passages[n % 4]}{rng.choice([' ', '  '])}{tail}")
    clean = [" ".join(prose(rng, 300)) + "\nthe same short line here" for _ in range(20)]
    found = by_id(dedup.dedup_lines(documents(spark, texts + clean)))
    assert len(found) == 80
    for n in range(60):
        text = found[n]["text"]
        if n < 4:
            assert text == texts[n]
        else:
            assert passages[n % 4] not in text
            assert text.split() == (own[n][0] + " " + own[n][1]).split()
        assert found[n]["n_chars"] == len(text)
    for n, text in enumerate(clean):
        assert found[60 + n]["text"] == text


def test_blocks_are_found_in_any_order():
    rng = random.Random(6)
    a, b, c = (np.array([rng.getrandbits(32) for _ in range(60)], np.uint32) for _ in range(3))
    early, late = np.concatenate([a, c, b]), np.concatenate([b, a])
    assert dedup.common_blocks(early, late) == [(0, 120)]
    assert dedup.common_blocks(a, b) == []
    assert dedup.common_blocks(a, a[:39]) == []


def _words(rng, n):
    return np.array([rng.getrandbits(32) for _ in range(n)], np.uint32)


def test_patience_decides(monkeypatch):
    rng = random.Random(21)
    p, u, v, w = (_words(rng, 120) for _ in range(4))
    early, late = np.concatenate([u, p, v]), np.concatenate([w, p])
    assert dedup.common_blocks(early, late) == [(120, 240)]
    # Lines that occur once are left to it: nothing else finds the block.
    monkeypatch.setattr(dedup, "patience", lambda a, b: [])
    assert dedup.common_blocks(early, late) == []


def test_blocks_equal_all_shared_runs():
    rng = random.Random(22)
    for n in range(300):
        size = rng.choice([40, 12, 3])
        pool = [_words(rng, rng.randrange(1, 90)) for _ in range(5)] + [np.tile(_words(rng, rng.randrange(1, 5)), 30)]

        def text():
            parts = []
            for _ in range(rng.randrange(6)):
                q = rng.choice(pool)
                at = rng.randrange(len(q))
                parts += [q[at : at + rng.randrange(1, 90)], _words(rng, rng.randrange(4))]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

        early, late = text(), text()
        runs = {tuple(early[i : i + size].tolist()) for i in range(len(early) - size + 1)}
        gone = np.zeros(len(late), bool)
        starts = [i for i in range(len(late) - size + 1) if tuple(late[i : i + size].tolist()) in runs]
        for i in starts:
            gone[i : i + size] = True
        ranges, held = dedup._alignment(dedup.Early(early, size), late)
        assert ranges == dedup._ranges(gone)
        assert [i for a, b in held for i in range(a, b)] == starts


def test_repeated_blocks_go_from_the_later_text():
    rng = random.Random(7)
    p, u, v, w, x, y = (np.array([rng.getrandbits(31) * 2 for _ in range(55)], np.uint32) for _ in range(6))
    both = [(55, 110), (165, 220)]
    join = np.concatenate
    assert dedup.common_blocks(join([x, p, y]), join([u, p, v, p, w])) == both
    assert dedup.common_blocks(join([x, p, y, p]), join([u, p, v])) == [(55, 110)]
    assert dedup.common_blocks(join([p, x, p, y]), join([u, p, v, p, w])) == both
    # A line of 20 words over and over.
    assert dedup.common_blocks(join([x, np.tile(p[:20], 3)]), join([u, np.tile(p[:20], 9)])) == [(55, 235)]


def test_blocks_without_a_whole_line():
    rng = random.Random(12)
    for _ in range(30):
        block = []
        while len(block) < 51:
            pair = np.array([*block[-1:], rng.getrandbits(31) * 2, 0], np.uint32)
            # No word whose hash ends a line.
            if not block or len(dedup.lines_of(pair[:2])[1]) == 1:
                block.append(int(pair[len(block[-1:])]))
        block = np.array(block, np.uint32)
        ends = [np.array([rng.getrandbits(31) * 2 for _ in range(30)], np.uint32) for _ in range(4)]
        early = np.concatenate([ends[0], block, ends[1]])
        late = np.concatenate([ends[2], block, ends[3]])
        assert dedup.common_blocks(early, late) == [(30, 81)]


def test_first_holder_that_repeats_a_passage(spark):
    rng = random.Random(15)
    passage = " ".join(prose(rng, 60))
    own = [" ".join(prose(rng, 20)) for _ in range(12)]
    texts = [f"{passage} {own[0]} {passage} {own[1]}"] + [f"{t} {passage}" for t in own[2:]]
    found = by_id(dedup.dedup_lines(documents(spark, texts)))
    assert found[0]["text"] == texts[0]
    assert [found[n]["text"].strip() for n in range(1, 11)] == own[2:]


def test_patience_anchors():
    a, b = np.array([1, 2, 3, 4, 5, 9, 9]), np.array([2, 1, 9, 3, 5])
    chain = dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in chain) and len(chain) == 3
    assert chain == sorted(chain)
    assert dedup.patience(a[:0], b) == []


def test_awkward_rows(spark):
    rng = random.Random(8)
    long = " ".join(prose(rng, 20_000))
    text = " ".join(prose(rng, 60))
    docs = documents(spark, [None, "", text, text, text, long, long + " end"], [0, 1, 3, 3, 4, 6, 9])
    rows = sorted((r["doc_id"], r["text"]) for r in dedup.dedup_lines(docs).where("doc_id > 0").collect())
    assert rows == [(1, ""), (3, text), (3, text), (4, ""), (6, long), (9, "end")]
    alone = documents(spark, [text, text], [None, 5])
    assert sorted(r["text"] for r in dedup.dedup_lines(alone).collect()) == [text, text]
    assert dedup.dedup_lines(documents(spark, [])).count() == 0
    assert dedup.dedup_lines(docs).columns == docs.columns
    assert 4 not in by_id(dedup.dedup_lines(docs, drop_emptied=True))


def test_a_common_passage_makes_one_pair_each(spark):
    rng = random.Random(9)
    passage = " ".join(prose(rng, 60))
    texts = [f"{' '.join(prose(rng, 20))} {passage}" for _ in range(300)]
    found = by_id(dedup.dedup_lines(documents(spark, texts)))
    assert sum(passage in r["text"] for r in found.values()) == 1


@pytest.mark.parametrize("most", [tables.MAX_BROADCAST_ROWS, -1])
def test_first_holder_that_shares_too_little(spark, most, monkeypatch):
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", most)
    rng = random.Random(13)
    texts, own = [], {}
    for _ in range(12):
        # The first holder has an edit in the middle, or only a half; two exact holders follow.
        p = prose(rng, 60)
        first = [*p[:30], "edited", *p[31:]] if rng.random() < 0.5 else p[:30]
        texts.append(" ".join([*prose(rng, 20), *first, *prose(rng, 20)]))
        texts.append(" ".join([*prose(rng, 20), *p[30:], *prose(rng, 20)]))
        texts.append(" ".join([*prose(rng, 20), *p, *prose(rng, 20)]))
        head, tail = prose(rng, 20), prose(rng, 20)
        own[len(texts)] = head + tail
        texts.append(" ".join([*head, *p, *tail]))
        own[len(texts)] = []
        texts.append(" ".join(p[5:45]))
    found = by_id(dedup.dedup_lines(documents(spark, texts)))
    for n, text in enumerate(texts):
        assert found[n]["text"].split() == own.get(n, text.split())


def test_no_run_of_an_earlier_document_is_left(spark):
    rng = random.Random(14)
    pool = [prose(rng, 120) for _ in range(6)]
    texts = []
    for _ in range(150):
        words = prose(rng, rng.randrange(25))
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(80)
            words += p[a : a + rng.randrange(25, 90)] + prose(rng, rng.randrange(15))
        texts.append(words)
    found = by_id(dedup.dedup_lines(documents(spark, [" ".join(t) for t in texts])))
    seen = set()
    for n, words in enumerate(texts):
        runs = [tuple(words[i : i + 40]) for i in range(len(words) - 39)]
        gone = {k for i, run in enumerate(runs) if run in seen for k in range(i, i + 40)}
        assert found[n]["text"].split() == [w for k, w in enumerate(words) if k not in gone]
        seen.update(runs)

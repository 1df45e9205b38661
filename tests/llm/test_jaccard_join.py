from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from rows import by_id, documents, words

from haberdash.llm import jaccard_join as join
from haberdash.llm import tables


def sets(text, size):
    found = words(text)
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def brute(rows, rule):
    """component_id by comparing all pairs."""
    known = [(i, sets(t, rule.words)) for i, t in rows]
    root = list(range(len(known)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            x, y = known[a][1], known[b][1]
            if x and y and rule.den * len(x & y) >= rule.num * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for n, (i, _) in enumerate(known):
        least[top(n)] = min(least.get(top(n), i), i)
    return {i: (len(s), least[top(n)]) for n, (i, s) in enumerate(known)}


def copies(seed, bases, many, edits, length=(3, 90)):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(*length))] for _ in range(bases)]
    texts = []
    for _ in range(many):
        text = list(rng.choice(base))
        for _ in range(rng.choice(edits)):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = f"x{rng.randrange(60)}"
            elif rng.random() < 0.5:
                text.insert(at, f"y{rng.randrange(60)}")
            elif len(text) > 2:
                text.pop(at)
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("rule", [join.CLOSE, join.NEAR])
@pytest.mark.parametrize("tile", [join.TILE_SHINGLES, 150])
def test_components_equal_brute_force(spark, rule, tile, monkeypatch):
    if tile == 150:  # neither form of a join may change the result
        monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", -1)
    texts = copies(3, 12, 150, [0, 1, 1, 2, 3]) + ["", None, "one", "one", "ONE two", "one  two"]
    found = by_id(join.linked(documents(spark, texts), rule, tile))
    expected = brute(list(enumerate(texts)), rule)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected


@pytest.mark.parametrize("rule", [join.CLOSE, join.NEAR])
def test_linked_sets_share_a_segment(rule):
    rng = random.Random(7)
    for _ in range(1500):
        size = rng.choice([4, 5, 8, 9, 10, 14, 25, 60, 200])
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(a)
        for _ in range(rng.randrange(1, 2 + size // 6)):
            b.discard(next(iter(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.getrandbits(64))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if a != b and rule.links(len(a & b), len(a), len(b)):
            assert len(np.intersect1d(join.segment_keys(rule, x), join.segment_keys(rule, y)))
            # Whatever segments are listed as frequent, one that both hold is kept.
            small = np.union1d(join.small_segment_keys(rule, x), join.small_segment_keys(rule, y))
            some = np.array(sorted(rng.sample(small.tolist(), len(small) * 2 // 3)), np.uint64)
            hot = (some, np.array([rng.randrange(2, 40) for _ in some], np.int64))
            assert len(np.intersect1d(join.segment_keys(rule, x, hot), join.segment_keys(rule, y, hot)))


def test_the_tree_leaves_no_link_out():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(50)]
    known = [np.array(sorted(set(rng.sample(base, 44)) | {rng.getrandbits(64)}), np.uint64) for _ in range(70)]
    tree = join.SignatureTree(known, np.arange(70))
    left = {tuple(sorted(p)) for i, j in tree.pairs(join.NEAR) for p in zip(i.tolist(), j.tolist())}
    for a in range(70):
        for b in range(a):
            if join.NEAR.links(len(np.intersect1d(known[a], known[b])), len(known[a]), len(known[b])):
                assert (b, a) in left


def test_unrelated_sets_are_pruned():
    rng = random.Random(4)
    known = [np.array(sorted(rng.getrandbits(64) for _ in range(100)), np.uint64) for _ in range(200)]
    assert not sum(len(i) for i, _ in join.SignatureTree(known, np.arange(200)).pairs(join.CLOSE))


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [None, "", "a b c d e f", "a b c d e f", "A b\tc d\ne f", long, long + " end", "a b c d e f"]
    ids = [0, 1, 5, 5, 4, 8, 7, None]
    rows = join.linked(documents(spark, texts, ids), join.CLOSE).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)
    expected = [(0, 0, 0), (1, 0, 1), (5, 4, 4), (5, 4, 4), (4, 4, 4), (8, 19_998, 7), (7, 19_999, 7), (None, 4, 4)]
    assert got == sorted(expected, key=repr)
    assert join.linked(documents(spark, []), join.CLOSE).count() == 0


def test_one_of_each_group_stays(spark):
    texts = ["a b c d e f g h i j", "x y", "a b c d e f g h i j", None, "x y", ""]
    docs = documents(spark, texts)
    kept = join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 5]


def test_bitmaps_stay_in_proportion_to_the_sets():
    rng = np.random.default_rng(3)
    sizes = np.array([100] * 9000 + [100_000])
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes[:50]] * 180
    sets.append(np.unique(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)))
    sizes = np.array([len(x) for x in sets])
    for rule in (join.CLOSE, join.NEAR):
        seen = np.zeros(len(sets), bool)
        for group in join.size_classes(sizes, rule):
            seen[group] = True
            tree = join.SignatureTree([sets[x] for x in group], np.arange(len(group)))
            assert sum(level[0].nbytes for level in tree.levels) <= 4 * sizes[group].sum()
        assert seen.all()


def test_linked_sizes_share_a_class():
    for rule in (join.CLOSE, join.NEAR):
        sizes = np.arange(1, 3000)
        groups = [set(sizes[group].tolist()) for group in join.size_classes(sizes, rule)]
        for a in range(1, 2300):
            assert any(a in group and a * rule.den // rule.num in group for group in groups)


def test_all_small_segments_of_several_sets_are_marked(spark, monkeypatch):
    # Also where the table has far fewer slots than there are such segments.
    for most in (join.MOST_SLOTS, 64):
        monkeypatch.setattr(join, "MOST_SLOTS", most)
        monkeypatch.setattr(join, "CHUNK_SLOTS", 1 << 10)
        texts = copies(5, 10, 120, [0, 1, 2], (20, 90))
        held = {}
        for tokens in join.shingle_sets(pa.array(texts), join.NEAR.words):
            for key in set(join.small_segment_keys(join.NEAR, tokens).tolist()):
                held[key] = held.get(key, 0) + 1
        hot = join.hot_segments(documents(spark, texts), join.NEAR)
        keys = np.array(sorted(held), np.uint64)
        marks = hot.marks(keys)
        least = np.array([sum(held[k] >= n for n in join.HOT_MARKS) for k in keys.tolist()])
        assert len(keys[least > 0]) > 64 and (marks >= least).all()
        if most > 64:
            assert (marks == least).mean() > 0.9
        found = by_id(join.linked(documents(spark, texts), join.NEAR))
        expected = brute(list(enumerate(texts)), join.NEAR)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected


def test_a_full_tile_takes_little_more_than_its_sets():
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    quoted = [" ".join(vocabulary[rng.integers(0, 3000, 400)]) for _ in range(3)]
    texts = [" ".join(vocabulary[rng.integers(0, 3000, 2600)]) + " " + quoted[i % 3] for i in range(700)]
    sets = list(join.shingle_sets(pa.array(texts), join.NEAR.words))
    sids = [join._set_hash(tokens, join.SET_SALT) for tokens in sets]
    rows = [[7] * len(texts), sids, sids, texts]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c[at : at + 100]) for c in rows], names=["tile", "sid", "label", "text"])
        for at in range(0, len(texts), 100)
    ]
    of_sets = sum(tokens.nbytes for tokens in sets)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in join._tiler(join.NEAR)(iter(batches))) == 0
        assert tracemalloc.get_traced_memory()[1] < 2.5 * of_sets
    finally:
        tracemalloc.stop()

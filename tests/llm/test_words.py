from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import words

from haberdash.llm.words import slices, split_words

TEXT = st.text(alphabet=st.sampled_from(list("aAbZ éß中\t\n\x0b.-1\x1c")), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_of_a_batch_are_those_of_each_text(texts):
    by_hash = {}
    for row, last, data, offsets in slices(pa.array(texts, pa.string())):
        found = split_words(data, offsets)
        for i in range(last - row):
            lo, hi = found.bounds[i], found.bounds[i + 1]
            got = [bytes(found.data[a:b]).decode() for a, b in zip(found.start[lo:hi], found.end[lo:hi])]
            assert got == words(texts[row + i])
            for word, value in zip(got, found.hash[lo:hi].tolist()):
                assert by_hash.setdefault(word, value) == value
    assert len(set(by_hash.values())) == len(by_hash)


def test_windows_do_not_cross_texts():
    column = pa.array(["a b c d", "", "b c d", "a"])
    (row, last, data, offsets), = slices(column)
    found = split_words(data, offsets)
    first, hashes = found.windows(3)
    assert first.tolist() == [0, 1, 4]
    assert hashes[1] == hashes[2] != hashes[0]


def test_a_text_longer_than_a_slice():
    column = pa.array(["x", "long word " * 100_000, "y"])
    assert sum(len(split_words(d, o).hash) for _, _, d, o in slices(column)) == 200_002

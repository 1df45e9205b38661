"""Line dedup by pairwise alignment: common blocks go from the later document.

A passage may lie inside a long line, and copies are often wrapped anew, so texts are cut
into lines after words chosen by a hash of that word and the next, not at line breaks:
the same passage is cut alike wherever it stands, but for its two ends.

1.  Anchors. Of the hashes of all runs of so many words, each document gives the
    smallest of every ``STRETCH`` runs in a row, with runs just so long that two
    documents which share ``MIN_WORDS`` words in a row share an anchor. Runs are long, so
    an anchor is rare but for real copies.
2.  Pairs. A document is aligned with the first document that holds one of its anchors;
    a passage in very many documents gives one pair for each, not all pairs. That first
    holder may share too little around the anchor. So where three or more documents hold
    an anchor, the runs of ``MIN_WORDS`` words around it that were not deleted are looked
    up themselves, and a document is aligned with the first holder of each: that pair
    shares a whole block. After it no run is left that an earlier document holds.
3.  Alignment, by patience diff on line hashes: lines that occur once in both and come
    in the same order are fixed, and from them common words are followed both ways.
    Blocks of at least ``MIN_WORDS`` words are deleted from the document with the larger
    id. Lines left over are aligned again until nothing more is found, which finds
    blocks that moved. That decides all words near a line that occurs once in both, or
    in the later text only. What is left, repeated lines and blocks without a whole line,
    is looked up by runs of ``MIN_WORDS`` words: whatever stands in the earlier text goes
    from the later one, wherever and however often either holds it.
4.  Deletion. The word ranges of a document's pairs are cut from its text, with the white
    space after each word. A document that loses all its words stays, with an empty text.

Hot groups: pairs are found by a minimum per anchor, combined in the map tasks; the rows
of one first document are split by the join.

Defined cases: NULL and empty texts are kept as they are; documents with NULL id neither
lose text nor take it from others; of rows that repeat an id, each is a document, and
equal ids are not aligned with each other; ``n_chars``, if there, follows the text; other
columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import broadcast_if_small, stored, table
from haberdash.llm.words import mix, run_hash, signed, slices, split_words, unsigned, word_edges

_U = np.uint64
STRETCH = 20
MIN_WORDS = 40
# One word in so many ends a line.
LINE_WORDS = 6
_RANGES = "array<struct<first: int, last: int>>"


def _least_in_a_row(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` values in a row."""
    width, least = 1, values
    while 2 * width <= size:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[: len(least) - (size - width)], least[size - width :]) if size > width else least


def anchors(hashes: np.ndarray, bounds: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the smallest of every ``STRETCH`` runs in a row; all if there are fewer, the least one."""
    out, of = [], []
    cuts = np.searchsorted(first, bounds)
    least = _least_in_a_row(hashes, STRETCH) if len(hashes) >= STRETCH else hashes[:0]
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[i]), int(cuts[i + 1]) - STRETCH + 1
        if b <= a + 1:
            out.append(hashes[a : cuts[i + 1]].min()[None])
        else:
            # Neighbours mostly share theirs.
            own = least[a:b][fresh[a:b]]
            out.append(np.unique(own if fresh[a] else np.append(own, least[a])))
        of.append(np.full(len(out[-1]), i))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _anchor_words(min_words: int) -> int:
    """Words of an anchor: ``min_words`` shared words hold ``STRETCH`` such runs, if they can."""
    return max(1, min_words - STRETCH + 1)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(32)).astype(np.uint32)


def _anchorer(min_words: int):
    size = _anchor_words(min_words)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, offsets in slices(batch.column(1)):
                words = split_words(data, offsets)
                # Of short hashes, so that runs are found again in word sequences.
                words = replace(words, hash=mix(_short(words.hash).astype(_U)))
                first, hashes = words.windows(size)
                found, text = anchors(hashes, words.bounds, words.text, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found)), batch.column(0).slice(row).take(pa.array(text)).cast(pa.int64())],
                    names=["anchor", "doc_id"],
                )

    return anchored


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as 32-bit word hashes."""
    for batch in batches:
        for row, last, data, offsets in slices(batch.column(1)):
            words = split_words(data, offsets)
            short = _short(words.hash)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, last - row).cast(pa.int64()),
                    pa.array([short[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:])], pa.binary()),
                ],
                names=["doc_id", "words"],
            )


def lines_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (and the end) and hash of each line."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, _U)
    plain = words.astype(_U)
    end = mix(plain[:-1] * _U(0x9E3779B97F4A7C15) + plain[1:]) % _U(LINE_WORDS) == 0
    start = np.concatenate([[0], np.flatnonzero(end) + 1, [len(words)]])
    inside = np.arange(len(words)) - np.repeat(start[:-1], np.diff(start))
    mixed = mix(plain + (inside.astype(_U) << _U(32)))
    return start, mix(np.add.reduceat(mixed, start[:-1]))


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of elements that occur once in both and stand in the same order."""
    once_a, at_a, count_a = np.unique(a, return_index=True, return_counts=True)
    once_b, at_b, count_b = np.unique(b, return_index=True, return_counts=True)
    once_a, at_a = once_a[count_a == 1], at_a[count_a == 1]
    once_b, at_b = once_b[count_b == 1], at_b[count_b == 1]
    _, i, j = np.intersect1d(once_a, once_b, assume_unique=True, return_indices=True)
    order = np.argsort(at_a[i])
    left, right = at_a[i][order], at_b[j][order]
    if not (right[1:] > right[:-1]).all():
        kept = _longest_rise(right.tolist())
        left, right = left[kept], right[kept]
    return list(zip(left.tolist(), right.tolist()))


def _longest_rise(places: list[int]) -> list[int]:
    """Numbers of the elements of a longest increasing run of places, by piles."""
    tops: list[int] = []
    pile_of: list[int] = []
    back = [-1] * len(places)
    for n, place in enumerate(places):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            pile_of.append(n)
        else:
            tops[pile], pile_of[pile] = place, n
        back[n] = pile_of[pile - 1] if pile else -1
    chain, at = [], pile_of[-1] if pile_of else -1
    while at >= 0:
        chain.append(at)
        at = back[at]
    return chain[::-1]


def _equal_words(x: np.ndarray, y: np.ndarray) -> int:
    """How many words are equal before the first that differ."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differs = x[at : at + step][: n - at] != y[at : at + step][: n - at]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, 4 * step
    return n


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words from each place."""
    if len(words) < size:
        return np.zeros(0, _U)
    plain = mix(words.astype(_U))
    return run_hash(plain, np.arange(len(words) - size + 1), size)


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``size`` words from one of ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


class Early:
    """The earlier text of a pair; what is known of it serves all its later texts."""

    def __init__(self, words: np.ndarray, min_words: int) -> None:
        self.words = words
        self.size = min_words
        self.start, self.lines = lines_of(words)
        self.known, self.times = np.unique(self.lines, return_counts=True)

    def times_of(self, lines: np.ndarray) -> np.ndarray:
        """How often lines occur."""
        if not len(self.known):
            return np.zeros(len(lines), np.int64)
        at = np.minimum(np.searchsorted(self.known, lines), len(self.known) - 1)
        return np.where(self.known[at] == lines, self.times[at], 0)

    @cached_property
    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_run_hashes(self.words, self.size), return_index=True)

    def held_runs(self, late: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Those of the ``wanted`` places of ``late`` whose runs stand here too."""
        if not len(wanted) or len(self.words) < self.size:
            return np.zeros(0, np.int64)
        known, at = self._runs
        hashes = _run_hashes(late, self.size)[wanted]
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        held = known[place] == hashes
        left, place = wanted[held], at[place[held]]
        for k in range(self.size if len(left) else 0):
            equal = self.words[place + k] == late[left + k]
            left, place = left[equal], place[equal]
        return left


def common_blocks(early: np.ndarray, late: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Word ranges of ``late`` that are aligned with blocks of ``early``."""
    return _alignment(Early(early, min_words), late)[0]


def _alignment(early: Early, late: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Word ranges of ``late`` to delete, and ranges of the first words of the runs that ``early`` holds.

    Blocks of different places in ``early`` may touch in ``late``; a run across both is not one of ``early``.
    """
    size = early.size
    if min(len(early.words), len(late)) < size:
        return [], []
    start, lines = lines_of(late)
    _, of, times = np.unique(lines, return_inverse=True, return_counts=True)
    there, once = early.times_of(lines), times[of] == 1
    fixed = (there == 1) & once
    blocks = _aligned_blocks(early, late, start, lines, int(fixed.sum()))
    held = np.zeros(len(late) + 1, np.int64)
    for first, last in blocks:
        if last - first >= size:
            held[first] += 1
            held[last - size + 1] -= 1
    held = np.cumsum(held) > 0
    held[early.held_runs(late, _undecided(len(late), size, start, fixed | (there == 0)))] = True
    starts = np.flatnonzero(held)
    return _ranges(_covered(starts, size, len(late))), _ranges(held[:-1])


def _aligned_blocks(
    early: Early, late: np.ndarray, start: np.ndarray, lines: np.ndarray, once_in_both: int
) -> list[tuple[int, int]]:
    """Word ranges of ``late`` around lines that patience fixes, as far as words go on alike."""
    open_a, open_b = np.arange(len(early.lines)), np.arange(len(lines))
    blocks, reached, fixed = [], {}, 0
    while fixed < once_in_both:
        chain = patience(early.lines[open_a], lines[open_b])
        if not chain:
            break
        fixed += len(chain)
        taken_a, taken_b = np.array(chain).T
        i, j = early.start[open_a[taken_a]], start[open_b[taken_b]]
        shift = i - j
        at = 0
        while at < len(j):
            a, b = int(i[at]), int(j[at])
            end = reached.get(a - b, -1)
            if end <= b:
                end = b + _equal_words(early.words[a:], late[b:])
                blocks.append((b - _equal_words(early.words[:a][::-1], late[:b][::-1]), end))
                reached[a - b] = end
            # On to the first line that is not inside this block.
            inside = int(np.searchsorted(j, end))
            other = np.flatnonzero(shift[at + 1 : inside] != a - b)
            at = at + 1 + int(other[0]) if len(other) else max(inside, at + 1)
        open_a, open_b = np.delete(open_a, taken_a), np.delete(open_b, taken_b)
    return blocks


def _undecided(n_words: int, size: int, start: np.ndarray, deciding: np.ndarray) -> np.ndarray:
    """First words of the runs without a whole line that tells where they may stand in the earlier text.

    A run's inner lines are cut alike in both texts. One that the earlier lacks excludes the
    run; one that occurs once in both was fixed by patience, with all words around it.
    """
    n = n_words - size + 1
    first, last = start[:-1][deciding], start[1:][deciding]
    # Inner lines have a word of the run on both sides.
    low, high = np.maximum(last + 1 - size, 0), np.minimum(first, n)
    inner = low < high
    step = np.bincount(low[inner], minlength=n + 1) - np.bincount(high[inner], minlength=n + 1)
    return np.flatnonzero(np.cumsum(step[:n]) == 0)


def _aligner(min_words: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, prepared = None, None
        for batch in batches:
            ids, ranges, runs = [], [], []
            for doc_id, late, early in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                early = early.as_py()
                # Later texts of one early text mostly follow each other.
                if early != known:
                    known, prepared = early, Early(np.frombuffer(early, np.uint32), min_words)
                found = _alignment(prepared, np.frombuffer(late.as_py(), np.uint32))
                if found[0]:
                    ids.append(doc_id)
                    for out, pairs in zip((ranges, runs), found):
                        out.append([{"first": a, "last": b} for a, b in pairs])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ranges, kind), pa.array(runs, kind)], names=["row", "ranges", "runs"]
            )

    return align


def _run_finder(min_words: int):
    """Runs of ``min_words`` words around given anchors, but for those that an earlier document is known to hold."""
    size = _anchor_words(min_words)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, known, runs_known in zip(*(c.to_pylist() for c in batch.columns)):
                if len(data) < 4 * min_words:
                    continue
                words = np.frombuffer(data, np.uint32)
                hashes = _run_hashes(words, min_words)
                at = np.flatnonzero(np.isin(_run_hashes(words, size), unsigned(np.array(known, np.int64))))
                # Runs that hold an anchor start from so many words before it.
                wanted = _covered(np.maximum(at - (min_words - size), 0), 1 + min_words - size, len(words) + min_words)
                for r in runs_known or ():
                    wanted[r["first"] : r["last"]] = False
                found = np.unique(hashes[wanted[: len(hashes)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found)), pa.array(np.full(len(found), row, np.int64))], names=["anchor", "row"]
                )

    return runs


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and the white space after each."""
    raw = text.encode()
    start, _ = word_edges(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    drop = np.zeros(len(start) + 1, bool)
    for a, b in ranges:
        drop[a:b] = True
    until = np.append(start[1:], len(raw))
    out, at = [], 0
    for a, b in _ranges(drop[:-1]):
        out.append(raw[at : start[a]])
        at = int(until[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def shared_blocks(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, ranges): word ranges to delete from rows of ``lines`` (row, doc_id, text).

    Rows are aligned in the order of (doc_id, row).
    """
    known = lines.where("doc_id IS NOT NULL")
    found = known.select("row", "text").mapInArrow(_anchorer(min_words), "anchor long, row long")
    place = known.select("row", "doc_id")
    shared = stored(_shared(_placed(stored(found, "anchors"), place, lines)), "shared-anchors")
    pairs = stored(_pairs(shared), "pairs")
    used = broadcast_if_small(stored(shared.select("row").distinct(), "aligned-rows"))
    texts = known.select("row", "text").join(used, "row")
    words = stored(texts.mapInArrow(_sequences, "row long, words binary"), "word-sequences")
    cuts = stored(_aligned(words, pairs, min_words), "cuts")
    # Anchors whose first holder is not the only earlier one.
    held = shared.where("n > 2").groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
    around = words.join(held, "row").join(cuts, "row", "left").select("row", "words", "anchors", "runs")
    runs = stored(around.mapInArrow(_run_finder(min_words), "anchor long, row long"), "runs")
    more = stored(_pairs(_shared(_placed(runs, place, lines))), "more-pairs")
    both = cuts.unionByName(_aligned(words, more, min_words)).drop("runs")
    return stored(both.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "all-cuts")


def _placed(found: DataFrame, place: DataFrame, lines: DataFrame) -> DataFrame:
    # The order of documents is that of ids; rows only name them.
    return found.join(place, "row") if not _row_is_id(lines) else found.withColumn("doc_id", F.col("row"))


def _shared(placed: DataFrame) -> DataFrame:
    """Anchors that several rows hold: (anchor, row, doc_id), the first holder and how many there are."""
    first = placed.groupBy("anchor").agg(F.min(F.struct("doc_id", "row")).alias("early"), F.count("*").alias("n"))
    return placed.join(first.where("n > 1"), "anchor")


def _pairs(shared: DataFrame) -> DataFrame:
    later = shared.where(F.col("doc_id") > F.col("early.doc_id"))
    return later.select("row", F.col("early.row").alias("early")).distinct()


def _aligned(words: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """(row, ranges, runs) of the stored pairs (row, early): see ``_alignment``."""
    both = words.join(broadcast_if_small(pairs), "row").withColumnRenamed("words", "late")
    both = both.join(words.select(F.col("row").alias("early"), F.col("words").alias("first")), "early")
    cuts = both.select("row", "late", "first").mapInArrow(
        _aligner(min_words), f"row long, ranges {_RANGES}, runs {_RANGES}"
    )
    # A document has no more pairs than anchors.
    return cuts.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "runs")))


def _row_is_id(lines: DataFrame) -> bool:
    return lines.schema["row"].metadata.get("is_id", False)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """Documents without the blocks they share with earlier ones; columns and rows kept.

    With ``drop_emptied`` a document that loses all its words goes.
    """
    # Columns go by number inside, so that no name can clash.
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")
    key, text = f"c{names.index('doc_id')}", f"c{at}"
    repeated = plain.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count()
    if repeated:
        lines = stored(plain.withColumn("row", F.monotonically_increasing_id()), "lines")
    else:
        lines = plain.withColumn("row", F.col(key).cast("long").alias("row", metadata={"is_id": True}))
    cuts = shared_blocks(lines.select("row", F.col(key).alias("doc_id"), F.col(text).alias("text")), min_words)
    joined = lines.join(broadcast_if_small(cuts), "row", "left").select(*plain.columns, "ranges")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            ranges = batch.column(batch.num_columns - 1)
            kept = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False)):
                texts[i] = cut(texts[i], [(r["first"], r["last"]) for r in ranges[int(i)].as_py()])
                kept[i] = not drop_emptied or bool(texts[i].strip(" \t\n\r\x0b\x0c"))
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield out if kept.all() else out.filter(pa.array(kept))

    cleaned = joined.mapInArrow(clean, plain.schema).toDF(*names)
    if "n_chars" in names:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for row, last, data, offsets in slices(batch.column(1)):
            counts[row:last] = np.diff(np.searchsorted(word_edges(data, offsets)[0], offsets))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=["doc_id", "text", "n_words"])


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents after the deletion, and how many words each has kept."""
    docs = dedup_lines(table(spark, folder, "documents")).select("doc_id", "text")
    return docs.mapInArrow(_word_counts, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_words long")

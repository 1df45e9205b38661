"""Spelling variants by dynamic programming along sorted vocabulary lists.

1.  Vocabulary. Runs of letters of whole texts are counted per document and added up in
    the map tasks; words of at least ``MIN_LENGTH`` letters that occur ``MIN_COUNT``
    times stay.
2.  Ranges. Two words that differ by one edit share their first half or the rest (of the
    shorter one's length ``m``), so each word goes, for both lengths it may pair at,
    into a list sorted forwards and one sorted backwards. Words with one beginning are a
    range of a list; pairs never cross ranges.
3.  Lists. Within a range each word is compared with the sorted list by a banded edit
    matrix (three cells a row). A row belongs to a prefix, so all words that share it,
    by the longest common prefixes of neighbours, reuse it, and a stretch whose shared
    prefix is beyond one edit in every cell is skipped. Ranges and words are taken
    through the same letter at once, in arrays.
4.  Hot ranges. A range of more than ``RANGE`` words is cut by its next letter. Pairs that
    the cut parts differ in just that letter, so they are equal without it, and meet
    by that; at most an alphabet of words does so at a time.
5.  Forms. Each word takes its most frequent neighbour, if that is ``RATIO`` times as
    frequent, and follows forms to the last by doubling of paths.

Defined cases: NULL and empty texts have no words; a document with NULL id has no
``slip``, so its words stay as they are; repeated rows count as they stand; ties of
frequency go to the smaller word in code-point order; extra columns do not matter; an
empty table gives no words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
SLIP = 31
# Words of a range that one task takes as a whole.
RANGE = 20_000
# Words of ranges taken through their letters at once, and counts held in a map task.
CHUNK = 20_000
HELD = 200_000

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
_LIST = "back boolean, m int, key string, text string, n long"
_NEAR = "word string, near string, near_n long"


def slipped(run: str, doc_id: int | None) -> str:
    """The run, without one letter if a hash of document and run says so."""
    if doc_id is not None:
        h = crc32(f"{doc_id}:{run}".encode())
        if h % SLIP == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"]
        )
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            # Lower-cases A-Z alone; runs that are too short stay so.
            lower = (text.as_py() or "").encode().lower().decode()
            for run, n in Counter(_RUN.findall(lower)).items():
                word = slipped(run, doc_id)
                if len(word) >= MIN_LENGTH:
                    total[word] += n
            if len(total) > HELD:
                yield flushed()
    yield flushed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of the documents and how often they occur; stored."""
    found = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    counts = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    return stored(counts, "vocabulary")


def _lists(words: DataFrame) -> DataFrame:
    """Each word in the lists of both shorter lengths, forwards and backwards, with the start of its range."""
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size), lambda m: m >= MIN_LENGTH)
    sides = words.select("word", "n", F.explode(lengths).alias("m")).select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    )
    half = F.floor(F.col("m") / 2).cast("int")
    text = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    key = F.substring(text, F.lit(1), F.when(F.col("back"), F.col("m") - half).otherwise(half))
    return sides.select("back", "m", key.alias("key"), text.alias("text"), "n")


def common_prefixes(letters: np.ndarray, range_of: np.ndarray) -> np.ndarray:
    """Letters that each row of a sorted list shares with the one before; -1 at the start of a range."""
    differs = letters[1:] != letters[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), letters.shape[1])
    return np.concatenate([[-1], np.where(range_of[1:] == range_of[:-1], shared, -1)])


def near_places(texts: list[str], range_of: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, other): rows of sorted lists that differ by one edit.

    Rows of one range share ``depths`` letters; their lengths differ by one at most.
    """
    size = np.array([len(t) for t in texts])
    width = int(size.max(initial=0)) + 2
    letters = np.zeros((len(texts), width), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letters[np.repeat(np.arange(len(texts)), size), np.concatenate([np.arange(n) for n in size] or [[]]).astype(int)] = flat
    shared = common_prefixes(letters, range_of)
    # A node is a stretch [first, last) of a range whose rows share so many letters.
    starts = np.flatnonzero(shared < 0)
    of = np.cumsum(shared < 0) - 1
    bounds = np.append(starts, len(texts))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    query, first, last = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    cells = np.zeros((3, 0), np.int8)
    for depth in range(int(depths.min(initial=0)), width - 1):
        fresh = np.flatnonzero(depths == depth)
        query = np.concatenate([query, fresh])
        first = np.concatenate([first, bounds[of[fresh]]])
        last = np.concatenate([last, bounds[of[fresh] + 1]])
        cells = np.concatenate([cells, np.repeat(np.array([[1], [0], [1]], np.int8), len(fresh), axis=1)], axis=1)
        # A row that ends here stands first in its stretch.
        ends = size[first] == depth
        band = size[query] - depth + 1
        hit = ends & (band >= 0) & (band <= 2)
        hit[hit] = cells[band[hit], np.flatnonzero(hit)] == 1
        found.append((query[hit], first[hit]))
        # The stretches of the next letter, and the row of each.
        below = np.flatnonzero((shared <= depth) & (size > depth))
        low, high = np.searchsorted(below, first), np.searchsorted(below, last)
        count = high - low
        whole = np.repeat(np.arange(len(query)), count)
        child = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(whole))
        query, last, cells = query[whole], last[whole], cells[:, whole]
        first = below[child]
        following = np.append(below, len(texts))[child + 1]
        last = np.minimum(last, following)
        letter = letters[first, depth]
        room = size[query] - depth
        left = np.minimum(cells[0] + (letters[query, max(depth - 1, 0)] != letter), cells[1] + 1)
        if depth == 0:
            left = cells[1] + 1
        middle = np.minimum(np.minimum(cells[1] + (letters[query, depth] != letter), cells[2] + 1), left + 1)
        right = np.minimum(cells[2] + (letters[query, np.minimum(depth + 1, width - 1)] != letter), middle + 1)
        cells = np.minimum(np.stack([left, np.where(room >= 1, middle, 2), np.where(room >= 2, right, 2)]), 2).astype(np.int8)
        alive = cells.min(axis=0) <= 1
        query, first, last, cells = query[alive], first[alive], last[alive], cells[:, alive]
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (query, query)


def _belongs(a: str, b: str, m: int, back: bool) -> bool:
    """Whether a pair is this list's to report: of its length, and not found forwards too."""
    if min(len(a), len(b)) != m:
        return False
    return not back or a[::-1][: m // 2] != b[::-1][: m // 2]


def _near_rows(back: list[bool], m: list[int], texts: list[str], n: list[int], pairs) -> pa.RecordBatch:
    words, others, counts = [], [], []
    for i, j in pairs:
        a, b = texts[i], texts[j]
        if _belongs(a, b, m[i], back[i]):
            words.append(a[::-1] if back[i] else a)
            others.append(b[::-1] if back[i] else b)
            counts.append(n[j])
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(counts, pa.int64())],
        names=["word", "near", "near_n"],
    )


def _list_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows sorted by (back, m, key, text), whole ranges at a time."""

    def scanned(rows: pa.Table) -> pa.RecordBatch:
        back, m, keys, texts, n = (rows.column(c).to_pylist() for c in range(5))
        fresh = [i == 0 or (back[i], m[i], keys[i]) != (back[i - 1], m[i - 1], keys[i - 1]) for i in range(len(keys))]
        depths = np.array([len(k) for k in keys])
        places = near_places(texts, np.cumsum(fresh), depths)
        return _near_rows(back, m, texts, n, zip(*(p.tolist() for p in places)))

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        # The last range may go on in the next batch.
        final = [rows.column(c)[count - 1].as_py() for c in range(3)]
        cut = count
        while cut and [rows.column(c)[cut - 1].as_py() for c in (2, 1, 0)] == final[::-1]:
            cut -= 1
        if cut:
            yield scanned(rows.slice(0, cut))
        held, count = rows.slice(cut).to_batches(), count - cut
    if count:
        yield scanned(pa.Table.from_batches(held).combine_chunks())


def _cross_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows that are equal without the letter at which their range was cut."""
    for batch in batches:
        for back, m, depth, rows in zip(*(c.to_pylist() for c in batch.columns)):
            texts, n = [r["text"] for r in rows], [r["n"] for r in rows]
            pairs = (
                (i, j)
                for i, j in permutations(range(len(rows)), 2)
                # Equal up to the next letter: found in the narrower range.
                if texts[i][: depth + 1] != texts[j][: depth + 1] and (rows[i]["cut"] or rows[j]["cut"])
            )
            yield _near_rows([back] * len(rows), [m] * len(rows), texts, n, pairs)


def _cross(hot: DataFrame) -> DataFrame:
    """Pairs parted by cutting hot ranges at the letter after ``key``."""
    depth = F.length("key")
    without = F.concat("key", F.expr("substring(text, length(key) + 2)"))
    both = F.array(
        F.struct(without.alias("meet"), F.lit(True).alias("cut")),
        F.struct(F.col("text").alias("meet"), F.lit(False).alias("cut")),
    )
    rows = hot.select("back", "m", depth.alias("depth"), "text", "n", F.explode(both).alias("v"))
    # Whole words meet only shorter ones' places: an alphabet of rows at most.
    groups = rows.groupBy("back", "m", "depth", "v.meet").agg(
        F.collect_list(F.struct("text", "n", F.col("v.cut").alias("cut"))).alias("rows")
    )
    groups = groups.where(F.size("rows") > 1).select("back", "m", "depth", "rows")
    return groups.mapInArrow(_cross_scan, _NEAR)


def near_words(words: DataFrame, most: int | None = None) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) that differ by one edit, both ways."""
    most = RANGE if most is None else most
    lists, crossed = _lists(words), []
    while True:
        counts = lists.groupBy("back", "m", "key").count().where(F.col("count") > most)
        hot = stored(counts.where(F.length("key") < F.col("m")).select("back", "m", "key", F.lit(True).alias("hot")), "hot-ranges")
        if not hot.limit(1).count():
            break
        lists = stored(lists.join(hot, ["back", "m", "key"], "left"), "ranges")
        wide = lists.where("hot").drop("hot")
        crossed.append(_cross(wide))
        narrower = wide.withColumn("key", F.expr("substring(text, 1, length(key) + 1)"))
        lists = lists.where("hot IS NULL").drop("hot").unionByName(narrower)
    ordered = lists.repartition("back", "m", "key").sortWithinPartitions("back", "m", "key", "text")
    pairs = ordered.mapInArrow(_list_scan, _NEAR)
    for more in crossed:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that each word of ``forms`` (word, form) leads to."""
    paths = stored(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        # Each round doubles the steps; a form is far more frequent than its word, so there are few.
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = paths.join(on, "root", "left")
        longer = stored(longer.select("word", F.coalesce("beyond", "root").alias("root"), "beyond"), "paths")
        if not longer.where("beyond IS NOT NULL").limit(1).count():
            return longer.select("word", "root")
        paths = longer.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with their near words' number, their form, and the root of its group."""
    pairs = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    near = stored(pairs.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near")
    frequent = F.col("near_n") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word",
        F.when(frequent, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("near_n")).alias("form_n"),
    )
    known = stored(known, "forms")
    roots = _roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return variants(vocabulary(table(spark, folder, "documents")))

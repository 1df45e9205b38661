"""Jaccard self-join of documents on word shingles, by signature trees.

Two documents link when ``den * |A & B| >= num * |A | B|``. No link is lost:

1.  Profiles. One pass over the texts gives each document the size of its shingle set
    and a hash of the set; equal sets are one node from here on.
2.  Groves. Linked sets of sizes up to u differ in at most d shingles, so if the hash
    space is cut into more than d segments, they agree on one. Documents that share a
    segment of a size band are joined to groves, the connected components. This only
    collects candidates: documents of different groves cannot link. Where segments are
    small (``Rule.relief``), those that several documents hold, parts of passages that
    all of them quote, are left out; more segments than d + 1 make up for them.
3.  Trees. A grove is dealt into tiles of bounded weight. In a tile, a tree over the
    sets of each two adjacent size classes holds in each node the OR of its token bitmaps, the range of set sizes and the
    most tokens that fell on a taken bit. Two nodes can hold a link only if their sizes
    fit and the largest possible overlap, common bits plus collisions, reaches the least
    overlap that their sizes ask for. The tree is traversed against itself from the
    root down; pairs of sets that are left are verified on the sets.
    Pairs already connected are not tested: components are asked for, not pairs.
4.  A grove of several tiles shares its first set with all of them, and sets outside its
    largest component then meet all others in a second round of tiles.

Hot groups: equal texts meet in the aggregation of step 1, which shrinks in the map
tasks; a segment that many sets share is cut down to one row per map task before the
shuffle; a large grove is split into tiles.

Defined cases: NULL and empty texts have the empty set and link with nothing; a text
with fewer words than a shingle is one shingle; documents with NULL id are kept and
belong to the component of an equal set, or to none (NULL); repeated rows are equal texts; extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.components import components
from haberdash.llm.tables import broadcast_if_small, stored, table
from haberdash.llm.words import mix, run_hash, signed, slices, split_words

_U = np.uint64
# Ratio of the sizes at both ends of a band.
BAND = 1.4
# Keys held in a map task before rows of equal keys are combined.
COMBINE_KEYS = 500_000
# From so many sets on, a key in one map task becomes a star.
STAR = 4
# Shingles of a tile, apart from a single larger document.
TILE_SHINGLES = 2_000_000
FANOUT = 8
# Segments of so many elements or fewer may be left out if so many sets hold them. All of
# these are marked in a table of two bits a slot, so many slots a segment while that is
# not more than the most slots: a broadcast of 16 MB.
SMALL, HOT_SETS, HOT_SLOTS, MOST_SLOTS = 3, 2, 16, 1 << 26
# Marks 1 to 3 stand for so many sets or more.
HOT_MARKS = (HOT_SETS, 4, 16)
# Slots that a task packs.
CHUNK_SLOTS = 1 << 20
SET_SALT, CHECK_SALT = 0x51ED270B, 0x2545F491
# Words of bitmap, pairs of nodes and shingles handled at once in a traversal.
POPCOUNT_WORDS, NODE_PAIRS, OVERLAP_SHINGLES = 1 << 19, 1 << 11, 1 << 18


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; a link from a similarity of num / den on.

    ``relief`` is the share of segments added so that small ones that several
    documents hold can be left out.
    """

    words: int
    num: int
    den: int
    relief: float = 0.0

    def links(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def least_overlap(self, total):
        """The smallest overlap of linked sets with ``total`` elements in sum."""
        return -(-self.num * total // (self.num + self.den))

    def most_apart(self, total: int) -> int:
        """The most elements that are in one only of linked sets with ``total`` in sum."""
        return total * (self.den - self.num) // (self.den + self.num)

    @property
    def smallest(self) -> int:
        """The smallest set that can link with a different one."""
        total = -(-(self.den + self.num) // (self.den - self.num))
        return max(1, (total - 1) // 2)


@dataclass(frozen=True)
class Band:
    """Sets of sizes first to last, cut into segments."""

    number: int
    first: int
    last: int
    reach: int
    """The largest set that can link with one of the band."""
    segments: int
    weak: int
    """Segments of up to so many elements are left out first."""
    spare: int
    """So many segments a document may leave out: linked ones share one more."""


@lru_cache(maxsize=4096)
def band(rule: Rule, number: int) -> Band:
    first = math.ceil(rule.smallest * BAND**number)
    last = math.ceil(rule.smallest * BAND ** (number + 1)) - 1
    reach = last * rule.den // rule.num
    need = rule.most_apart(last + reach) + 1
    for weak in (1, 0):
        spare = 0
        for _ in range(6):
            mean = first / (need + spare)
            share = math.exp(-mean) * (1 + mean * weak)
            spare = math.ceil(share * (need + spare) + math.sqrt(need) / 4 + 1)
        if spare <= 0.4 * need + 4 or not weak:
            break
    if rule.relief:
        spare += math.ceil(rule.relief * need) + 1
    return Band(number, first, last, reach, need + spare, weak, spare)


def bands_of(rule: Rule, size: int) -> list[Band]:
    """The bands in which a set of this size can meet a linked one."""
    if size < rule.smallest:
        return []
    number = int(math.log(size / rule.smallest) / math.log(BAND))
    while band(rule, number).last < size:
        number += 1
    while number and band(rule, number).first > size:
        number -= 1
    own = [band(rule, number)]
    while number and band(rule, number - 1).reach >= size:
        number -= 1
        own.append(band(rule, number))
    return own


@lru_cache(maxsize=4096)
def _edges(segments: int) -> np.ndarray:
    return np.array([-(-(j << 64) // segments) for j in range(1, segments)], dtype=_U)


@lru_cache(maxsize=4096)
def _salts(number: int, segments: int) -> np.ndarray:
    return mix(np.arange(segments, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(number + 1) * _U(1 << 32))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for row, last, data, offsets in slices(column):
        found = split_words(data, offsets)
        n = np.diff(found.bounds)
        first, hashes = found.windows(words)
        bounds = np.searchsorted(first, found.bounds)
        for i in range(last - row):
            if n[i] >= words:
                yield np.unique(hashes[bounds[i] : bounds[i + 1]])
            elif n[i]:
                yield run_hash(found.hash, found.bounds[i : i + 1], int(n[i]))
            else:
                yield np.zeros(0, _U)


def _set_hash(tokens: np.ndarray, salt: int) -> int:
    total = mix(tokens ^ _U(salt)).sum(dtype=_U) + _U(len(tokens)) if len(tokens) else _U(0)
    return int(mix(np.array([total], _U)).view(np.int64)[0])


def _profiler(rule: Rule):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sids, checks = [], [], []
            for tokens in shingle_sets(batch.column(1), rule.words):
                sizes.append(len(tokens))
                sids.append(_set_hash(tokens, SET_SALT) if len(tokens) else None)
                checks.append(_set_hash(tokens, CHECK_SALT) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sids, pa.int64()),
                    pa.array(checks, pa.int64()),
                ],
                names=["doc_id", "n_shingles", "sid", "check"],
            )

    return profile


@dataclass(frozen=True)
class HotSegments:
    """A mark for every segment key that several sets hold, in the slot of its leading bits.

    Keys that share a slot share the larger mark: a key too many is marked, none too few.
    """

    bits: int
    packed: np.ndarray
    """Four slots a byte."""

    def marks(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> _U(64 - self.bits)
        shift = ((at & _U(3)) << _U(1)).astype(np.uint8)
        return (self.packed[at >> _U(2)] >> shift & np.uint8(3)).astype(np.int64)


def _held(hot: HotSegments | tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """How frequent segments are: by their mark, or as sorted keys and documents list them; 0 for others."""
    if isinstance(hot, HotSegments):
        return hot.marks(keys)
    if not len(hot[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
    return np.where(hot[0][at] == keys, hot[1][at], 0)


def segment_keys(
    rule: Rule, tokens: np.ndarray, hot: HotSegments | tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Keys of the segments of a sorted set, over all its bands.

    Each band leaves out up to ``spare`` of them: weak ones, then small ones that are in
    ``hot``, the most frequent first. As all documents go by one order,
    the last segment in it that two linked sets share is kept by both.
    """
    keys = []
    for own, counts, b in _segments(rule, tokens):
        weak = counts <= b.weak
        droppable = weak
        held = np.zeros(len(own), np.int64)
        if hot is not None:
            small = np.flatnonzero(~weak & (counts <= SMALL))
            held[small] = _held(hot, own[small])
            droppable = weak | (held > 0)
        out = np.flatnonzero(droppable)
        if len(out) > b.spare:
            out = out[np.lexsort((own[out], -held[out], ~weak[out]))][: b.spare]
        kept = np.ones(len(own), bool)
        kept[out] = False
        keys.append(own[kept])
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def small_segment_keys(rule: Rule, tokens: np.ndarray) -> np.ndarray:
    """Keys of the segments that may be left out if several documents hold them."""
    keys = [own[(counts > b.weak) & (counts <= SMALL)] for own, counts, b in _segments(rule, tokens)]
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def _segments(rule: Rule, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Band]]:
    """Keys and sizes of all segments of a sorted set, band by band."""
    sums = np.zeros(len(tokens) + 1, _U)
    np.cumsum(mix(tokens ^ _U(0x7F4A7C15)), out=sums[1:])
    for b in bands_of(rule, len(tokens)):
        cuts = np.concatenate([[0], np.searchsorted(tokens, _edges(b.segments)), [len(tokens)]])
        counts = np.diff(cuts)
        own = mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ _salts(b.number, b.segments))
        yield own, counts, b


def _combined(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
    """(key, sid) rows, with many sets of one key turned into a star around the smallest."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[fresh], sids[fresh]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    count = np.diff(np.append(start, len(keys)))
    head, many = np.repeat(start, count), np.repeat(count > STAR, count)
    spoke = np.flatnonzero(many & (head != np.arange(len(keys))))
    hub = sids[head[spoke]]
    # A spoke gets a key of its own, the same for each time the pair is found.
    own = mix(mix(hub.view(_U)) + sids[spoke].view(_U))
    plain = np.ones(len(keys), bool)
    plain[spoke] = False
    pairs = np.unique(np.stack([own, hub.view(_U), sids[spoke].view(_U)], axis=1), axis=0) if len(spoke) else None
    out_keys, out_sids = [keys[plain]], [sids[plain]]
    if pairs is not None:
        out_keys += [pairs[:, 0], pairs[:, 0]]
        out_sids += [pairs[:, 1].view(np.int64), np.ascontiguousarray(pairs[:, 2]).view(np.int64)]
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.concatenate(out_keys))), pa.array(np.concatenate(out_sids))], names=["key", "sid"]
    )


def _small_keys(rule: Rule):
    """Small segment keys and how many sets of a stretch of the input hold each."""

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        every, sets = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(every)), pa.array(sets)], names=["key", "sets"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), rule.words):
                keys.append(small_segment_keys(rule, tokens))
                held += len(keys[-1])
                if held >= COMBINE_KEYS:
                    yield counted(keys)
                    keys, held = [], 0
        if held:
            yield counted(keys)

    return emit


def _packer(slots: int):
    """Rows (chunk, slot, mark) of a chunk of slots to its packed marks."""

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        marks = np.zeros((min(slots, CHUNK_SLOTS) // 4, 4), np.uint8)
        at = group["slot"].to_numpy() % CHUNK_SLOTS
        marks[at >> 2, at & 3] = group["mark"].to_numpy()
        packed = (marks << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "packed": [packed.tobytes()]})

    return pack


def hot_segments(texts: DataFrame, rule: Rule) -> HotSegments | None:
    """Marks of all small segments that at least ``HOT_SETS`` texts hold.

    Any selection is right, as long as all documents use the same. Tasks pack the marks, so
    what is gathered and sent has the size of the table, not of the segments.
    """
    counts = texts.select("text").mapInArrow(_small_keys(rule), "key long, sets long")
    counts = counts.groupBy("key").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= HOT_SETS)
    counts = stored(counts, "hot-segments")
    many = counts.count()
    if not many:
        return None
    bits = min(MOST_SLOTS, HOT_SLOTS * max(many, 64)).bit_length() - 1
    mark = sum((F.col("sets") >= least).cast("int") for least in HOT_MARKS)
    slots = counts.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"), mark.alias("mark"))
    slots = slots.groupBy("slot").agg(F.max("mark").alias("mark"))
    chunks = slots.withColumn("chunk", F.floor(F.col("slot") / F.lit(CHUNK_SLOTS)).cast("long")).groupBy("chunk")
    packed = np.zeros((1 << bits) // 4, np.uint8)
    for row in chunks.applyInArrow(_packer(1 << bits), "chunk long, packed binary").toArrow().to_pylist():
        part = np.frombuffer(row["packed"], np.uint8)
        packed[row["chunk"] * (CHUNK_SLOTS // 4) :][: len(part)] = part
    return HotSegments(bits, packed)


def _keyer(rule: Rule, hot=None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, held = [], [], 0
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), rule.words):
                own = segment_keys(rule, tokens, hot.value if hot else None)
                if not len(own):
                    continue
                keys.append(own)
                sids.append(np.full(len(own), _set_hash(tokens, SET_SALT), np.int64))
                held += len(own)
                if held >= COMBINE_KEYS:
                    yield _combined(np.concatenate(keys), np.concatenate(sids))
                    keys, sids, held = [], [], 0
        if held:
            yield _combined(np.concatenate(keys), np.concatenate(sids))

    return emit


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each set to the smallest one of its key; rows come sorted by key and set."""
    key, hub = None, 0
    for batch in batches:
        keys, sids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        fresh = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        hubs = np.where(start >= 0, sids[start], hub)
        key, hub = keys[-1], hubs[-1]
        edge = np.flatnonzero(hubs != sids)
        if len(edge):
            pairs = np.unique(np.stack([sids[edge], hubs[edge]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))],
                names=["a", "b"],
            )


def size_classes(sizes: np.ndarray, rule: Rule) -> Iterator[np.ndarray]:
    """Numbers of sets of two adjacent size classes each; linked sets are in one of these groups.

    A class spans a little more than the largest ratio of linked sizes, so bitmaps as wide
    as the largest set of a group asks for stay in proportion to every set of it.
    """
    of = np.floor(np.log(sizes) / math.log(rule.den / rule.num * 1.001)).astype(np.int64)
    for number in np.unique(of).tolist():
        yield np.flatnonzero((of == number) | (of == number + 1))


class SignatureTree:
    """Sets of similar size in a tree whose nodes bound the overlap with any set of another node."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = max(64, 1 << int(4 * sizes.max() - 1).bit_length())
        bitmaps = np.zeros((len(sets), bits // 64), _U)
        for some in _stretches(sizes):
            place = np.concatenate(sets[some]) & _U(bits - 1)
            row = np.repeat(np.arange(some.start, some.stop), sizes[some])
            np.bitwise_or.at(bitmaps, (row, (place >> _U(6)).astype(np.int64)), _U(1) << (place & _U(63)))
        excess = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, excess, labels, labels)]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below[0]), FANOUT)
            reduce = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(reduce, below)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
        """Which node pairs may hold a link between sets that are not connected yet."""
        bitmaps, least, most, excess, low, high = self.levels[level]
        small, large = np.minimum(least[i], least[j]), np.maximum(least[i], least[j])
        keep = rule.num * large <= rule.den * np.minimum(most[i], most[j])
        keep &= ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        need = rule.least_overlap(small + large)
        step = max(1, POPCOUNT_WORDS // bitmaps.shape[1])
        left = np.flatnonzero(keep)
        for at in range(0, len(left), step):
            part = left[at : at + step]
            common = np.bitwise_count(bitmaps[i[part]] & bitmaps[j[part]]).sum(axis=1, dtype=np.int64)
            keep[part] = common + np.minimum(excess[i[part]], excess[j[part]]) >= need[part]
        return keep

    def pairs(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of set numbers that the bounds leave over."""
        top = len(self.levels) - 1
        yield from self._descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64), rule)

    def _descend(self, level: int, i: np.ndarray, j: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            apart = i != j
            yield i[apart], j[apart]
            return
        count = len(self.levels[level - 1][0])
        step = NODE_PAIRS
        for at in range(0, len(i), step):
            a = (i[at : at + step, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            b = (j[at : at + step, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
            real = (a < count) & (b < count) & (a <= b)
            a, b = a[real], b[real]
            possible = self._possible(level - 1, a, b, rule) if level > 1 else (a != b)
            if level == 1:
                possible &= self._possible(0, a, b, rule)
            yield from self._descend(level - 1, a[possible], b[possible], rule)


def _stretches(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of sets with about ``OVERLAP_SHINGLES`` elements, or one larger set."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + OVERLAP_SHINGLES, "right")))
        yield slice(first, last)
        first = last


def _overlaps(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of one set with each of the others, none of them empty."""
    sizes, found = np.array([len(s) for s in sets], np.int64), []
    for some in _stretches(sizes):
        tokens = np.concatenate(sets[some])
        at = np.searchsorted(one, tokens)
        at[at == len(one)] = 0
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        found.append(np.add.reduceat((one[at] == tokens).astype(np.int64), starts))
    return np.concatenate(found)


def connect(sets: list[np.ndarray], labels: np.ndarray, rule: Rule, pivots: int = 8) -> np.ndarray:
    """Labels of the components of linked sets; equal labels at the start are connected already."""
    order = sorted(range(len(sets)), key=lambda x: (int(sets[x][0]), len(sets[x])))
    sets = [sets[x] for x in order]
    label = labels[order].copy()
    sizes = np.array([len(s) for s in sets])

    def join(a: int, b: int) -> None:
        label[label == max(a, b)] = min(a, b)

    # Large groups of near copies collapse around a few of them first.
    for pivot in range(0, len(sets), max(1, len(sets) // pivots)) if len(sets) > 2 * pivots else ():
        others = np.flatnonzero(label != label[pivot])
        if not len(others):
            break
        overlap = _overlaps(sets[pivot], [sets[x] for x in others])
        linked = others[rule.links(overlap, sizes[others], sizes[pivot])]
        for other in np.unique(label[linked]):
            join(int(other), int(label[pivot]))
    for group in size_classes(sizes, rule):
        if len(np.unique(label[group])) < 2:
            continue
        for i, j in SignatureTree([sets[x] for x in group], label[group]).pairs(rule):
            for a, b in zip(group[i].tolist(), group[j].tolist()):
                if label[a] != label[b]:
                    overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if rule.links(overlap, sizes[a], sizes[b]):
                        join(int(label[a]), int(label[b]))
    out = np.empty_like(label)
    out[order] = label
    return out


def _tiler(rule: Rule):
    """Rows (tile, sid, label, text), tile by tile, to edges between connected sets."""

    def solve(own: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        start = np.array([label for label, _ in own.values()], np.int64)
        found = connect([tokens for _, tokens in own.values()], start, rule)
        hub: dict[int, int] = {}
        edges = []
        for sid, label in zip(own, found.tolist()):
            if hub.setdefault(label, sid) != sid:
                edges.append((sid, hub[label]))
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a tile only its sets are held, not the texts.
        tile, own = None, {}
        for batch in batches:
            numbers = (batch.column(c).to_pylist() for c in range(3))
            for t, sid, label, tokens in zip(*numbers, shingle_sets(batch.column(3), rule.words)):
                if t != tile:
                    if len(own) > 1:
                        yield solve(own)
                    tile, own = t, {}
                # Rows of a repeated id may bring a text of another set.
                if len(tokens) and _set_hash(tokens, SET_SALT) == sid:
                    own[sid] = (label, tokens)
        if len(own) > 1:
            yield solve(own)

    return tiles


def _solved(members: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Edges found in the tiles of ``members`` (tile, doc_id, sid, label)."""
    # Most documents share no segment with any other: their texts stay where they are.
    members = broadcast_if_small(stored(members, "members"))
    rows = docs.join(members, "doc_id").select("tile", "sid", "label", "text")
    rows = rows.repartition("tile").sortWithinPartitions("tile", "sid")
    return rows.mapInArrow(_tiler(rule), "a long, b long")


def _deal(weight, tile_shingles: int):
    return F.greatest(F.lit(1), F.ceil(weight / F.lit(tile_shingles))).cast("long")


def _chunk(of) -> F.Column:
    return F.pmod(F.xxhash64("sid"), of)


def _links(docs: DataFrame, nodes: DataFrame, groves: DataFrame, rule: Rule, tile_shingles: int) -> DataFrame:
    """Edges (a, b) between set hashes that connect every two linked sets."""
    placed = nodes.join(groves.select(F.col("node").alias("sid"), F.col("root").alias("grove")), "sid")
    weights = placed.groupBy("grove").agg(F.sum("n").alias("weight"))
    dealt = stored(
        placed.join(weights, "grove").withColumn("tiles", _deal(F.col("weight"), tile_shingles)), "dealt"
    )
    own = F.when(F.col("sid") == F.col("grove"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    first = dealt.withColumn("part", F.explode(F.coalesce(own, F.array(_chunk(F.col("tiles"))))))
    first = first.select(F.xxhash64("grove", "part").alias("tile"), "doc_id", "sid", F.col("sid").alias("label"))
    links = stored(_solved(first, docs, rule), "links")
    large = dealt.where("tiles > 1")
    if not large.limit(1).count():
        return links
    roots = components(links)
    label = F.coalesce("root", "sid")
    large = large.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", label).drop("root")
    large = stored(large, "large-groves")
    counts = large.groupBy("grove", "label").agg(F.count("*").alias("n_sets"))
    main = counts.groupBy("grove").agg(F.max_by("label", F.struct("n_sets", "label")).alias("main"))
    rest = large.join(main, "grove").where("label <> main").drop("main")
    rest_weight = rest.groupBy("grove").agg(F.sum("n").alias("rest_weight"))
    rest = rest.join(rest_weight, "grove").withColumn("rest_tiles", _deal(F.col("rest_weight"), tile_shingles))
    rest_tiles = rest.select("grove", "rest_tiles").distinct()
    left = large.join(rest_tiles, "grove").select(
        "grove",
        "doc_id",
        "sid",
        "label",
        _chunk(F.col("tiles")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_tiles") - 1)).alias("j"),
    )
    right = rest.select(
        "grove",
        "doc_id",
        "sid",
        "label",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("i"),
        _chunk(F.col("rest_tiles")).alias("j"),
    )
    second = left.unionByName(right).distinct()
    second = second.select(F.xxhash64("grove", "i", "j").alias("tile"), "doc_id", "sid", "label")
    return links.unionByName(stored(_solved(second, docs, rule), "more-links"))


def linked(docs: DataFrame, rule: Rule, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and class_id.

    The class is the smallest id of equal shingle sets, the component that of all
    documents that links reach.
    """
    texts = docs.select("doc_id", "text")
    profiles = stored(
        texts.mapInArrow(_profiler(rule), "doc_id long, n_shingles long, sid long, check long"), "profiles"
    )
    nodes = (
        profiles.where("sid IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("sid")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    )
    known = texts.where("doc_id IS NOT NULL")
    hot = docs.sparkSession.sparkContext.broadcast(hot_segments(known, rule)) if rule.relief else None
    keys = known.select("text").mapInArrow(_keyer(rule, hot), "key long, sid long")
    stars = keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_stars, "a long, b long")
    groves = components(stars)
    links = _links(known, nodes, groves, rule, tile_shingles)
    roots = components(links)
    classes = profiles.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("class_id"))
    # Two sets with one hash would be taken for equal ones.
    twice = profiles.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("check").alias("least"), F.max("check").alias("most")
    )
    same = F.assert_true(F.col("least") == F.col("most"), F.lit("two shingle sets have one hash"))
    checked = twice.select("sid", same.alias("same"))
    classes = classes.join(checked, "sid").where("same IS NULL").drop("same")
    placed = classes.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
    placed = placed.select("sid", "class_id", F.coalesce("root", "sid").alias("root"))
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    found = placed.join(least, "root").drop("root")
    return profiles.join(found, "sid", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


# The contract of the query, and the rule of near-duplicate stages.
CLOSE = Rule(words=3, num=9, den=10)
NEAR = Rule(words=5, num=4, den=5, relief=0.5)


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return linked(table(spark, folder, "documents"), CLOSE).drop("class_id")


def one_of_each(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """Documents with only the smallest id of each component; all columns kept.

    A document with NULL id, or without words, stays. Of rows that repeat the smallest
    id all stay.
    """
    found = linked(docs, rule)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
),
l AS (
  SELECT o.a, o.b FROM o JOIN n AS x ON x.doc_id = o.a JOIN n AS y ON y.doc_id = o.b
  WHERE 100 * common >= 90 * (x.n + y.n - common)
),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

"""Benchmark decontamination: hashed test n-grams against document windows.

The windows of all benchmark items, 13 words each (a shorter item is one window),
form a hash set. Every document is scanned once: window hashes that are in the set
are verified word by word, words inside verified windows are hit, and a document
with at least 5 % of its words hit is contaminated.

The set is broadcast while it holds at most ``MAX_BROADCAST_WINDOWS`` windows. A
larger benchmark is joined, with the same result: document windows, a few numbers
each, meet distinct benchmark windows by hash in a shuffle; what matches goes back to
its document, whose words are compared with the window's and then cut or counted.

Defined cases: NULL or empty text has no words, no hits and is clean; an item
without words has no windows; an item with NULL id marks words but is not listed;
item ids may have any type and are listed as text; repeated items or documents count
as they stand, items once per id; NULL document ids are kept; extra columns of
documents pass through ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table
from haberdash.llm.words import ALNUM, Words, run_hash, signed, slices, split_words

WINDOW = 13
# 16 bytes each: a broadcast of at most 64 MB.
MAX_BROADCAST_WINDOWS = 4_000_000
# A document is contaminated from this part of its words on: 1 / 20.
CONTAMINATED_PART = 20

_FINDINGS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first: int, last: int>>"


class WindowSet:
    """Benchmark windows by hash, with the words to verify a hit."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        self.ids = [None if i is None else str(i) for i, _ in items]
        hashes, owners, lengths, firsts, lists = [], [], [], [], []
        base = 0
        column = pa.array([t for _, t in items], pa.string())
        for row, last, data, offsets in slices(column):
            words = split_words(data, offsets, ALNUM)
            lists.append(words.hash)
            for i in range(last - row):
                lo, hi = words.bounds[i], words.bounds[i + 1]
                length = min(size, hi - lo)
                if not length:
                    continue
                first = np.arange(lo, hi - length + 1)
                hashes.append(run_hash(words.hash, first, length))
                owners.append(np.full(len(first), row + i))
                lengths.append(np.full(len(first), length))
                firsts.append(first + base)
            base += len(words.hash)
        self.words = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        empty = np.zeros(0, np.int64)
        hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owner = np.concatenate(owners)[order] if owners else empty
        self.length = np.concatenate(lengths)[order] if lengths else empty
        self.first = np.concatenate(firsts)[order] if firsts else empty
        self.sizes = sorted(set(self.length.tolist()))
        # Most windows are turned away by one look into a table of low bits.
        self.mask = np.uint64((1 << max(10, (16 * len(hashes)).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[self.hashes & self.mask] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and owner of every verified hit."""
        found = []
        for size in self.sizes:
            first, hashes = words.windows(size)
            near = np.flatnonzero(self.seen[hashes & self.mask])
            first, hashes = first[near], hashes[near]
            lo = np.searchsorted(self.hashes, hashes, "left")
            count = np.searchsorted(self.hashes, hashes, "right") - lo
            first = np.repeat(first, count)
            entry = np.repeat(lo, count) + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            right = self.length[entry] == size
            first, entry = first[right], entry[right]
            for j in range(size):
                same = words.hash[first + j] == self.words[self.first[entry] + j]
                first, entry = first[same], entry[same]
            found.append((first, np.full(len(first), size), self.owner[entry]))
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(part) for part in zip(*found))


def _cover(n: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie inside a run."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _scan(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for batch in batches:
            ids = batch.column(0)
            for row, last, data, offsets in slices(batch.column(1)):
                words = split_words(data, offsets, ALNUM)
                first, length, owner = windows.hits(words)
                hit = _cover(len(words.hash), first, length)
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
                items: list[list[str]] = [[] for _ in range(last - row)]
                text = words.text[first]
                for t in np.unique(text):
                    names = {windows.ids[o] for o in np.unique(owner[text == t])}
                    items[t] = sorted(x for x in names if x is not None)
                spans: list[list[dict]] = [[] for _ in range(last - row)]
                for t in np.flatnonzero(n_hit):
                    spans[t] = _hit_spans(words, offsets, t, hit)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, last - row).cast(pa.int64()),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return scan


def _hit_spans(words: Words, offsets: np.ndarray, t: int, hit: np.ndarray) -> list[dict]:
    """Runs of hit words of text ``t`` in code points, end exclusive."""
    lo, hi = words.bounds[t], words.bounds[t + 1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
    points = np.cumsum((words.data[offsets[t] : offsets[t + 1]] & 0xC0) != 0x80)
    points = np.concatenate([[0], points])
    first = points[words.start[lo + edge[::2]] - offsets[t]]
    last = points[words.end[lo + edge[1::2] - 1] - offsets[t]]
    return [{"first": int(a), "last": int(b)} for a, b in zip(first, last)]


def _cut(text: str, spans: list[dict]) -> str:
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["first"]])
        at = span["last"]
    return "".join([*kept, text[at:]])


def _document_windows(sizes: list[int]):
    """Rows (window, size, row, at) of all windows of the given sizes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in slices(batch.column(1)):
                words = split_words(data, offsets, ALNUM)
                for size in sizes:
                    first, hashes = words.windows(size)
                    text = words.text[first]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(hashes)),
                            pa.array(np.full(len(first), size, np.int32)),
                            batch.column(0).slice(row).take(pa.array(text)),
                            pa.array(first - words.bounds[text], pa.int64()),
                        ],
                        names=["window", "size", "row", "at"],
                    )

    return emit


def _word_list(words: Words, t: int) -> list[bytes]:
    lo, hi = words.bounds[t], words.bounds[t + 1]
    if lo == hi:
        return []
    base = words.start[lo]
    data = words.data[base : words.end[hi - 1]].tobytes()
    return [data[a:b] for a, b in zip((words.start[lo:hi] - base).tolist(), (words.end[lo:hi] - base).tolist())]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (window, size, phrase, item) of benchmark items."""
    for batch in batches:
        for row, last, data, offsets in slices(batch.column(1)):
            words = split_words(data, offsets, ALNUM)
            for i in range(last - row):
                lo, hi = words.bounds[i], words.bounds[i + 1]
                size = int(min(WINDOW, hi - lo))
                if not size:
                    continue
                first = np.arange(hi - lo - size + 1)
                hashes = run_hash(words.hash, first + lo, size)
                listed = _word_list(words, i)
                phrases = [b" ".join(listed[f : f + size]).decode() for f in first.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(hashes)),
                        pa.array(np.full(len(first), size, np.int32)),
                        pa.array(phrases, pa.string()),
                        pa.array([batch.column(0)[row + i].as_py()] * len(first), pa.string()),
                    ],
                    names=["window", "size", "phrase", "item"],
                )


def _verified(texts: pa.Array, near: pa.Array) -> Iterator[tuple[int, int, list[int], list[dict]]]:
    """Words, hit words, window numbers and spans of each text, after comparing the windows in ``near``."""
    for row, last, data, offsets in slices(texts):
        words = split_words(data, offsets, ALNUM)
        for t in range(last - row):
            n_words = int(words.bounds[t + 1] - words.bounds[t])
            candidates = near[row + t].as_py()
            if not candidates:
                yield n_words, 0, [], []
                continue
            listed = _word_list(words, t)
            same = [
                c for c in candidates if b" ".join(listed[c["at"] : c["at"] + c["size"]]) == c["phrase"].encode()
            ]
            hit = np.zeros(len(words.hash), bool)
            first = np.array([c["at"] for c in same], np.int64)
            hit[words.bounds[t] : words.bounds[t + 1]] = _cover(n_words, first, np.array([c["size"] for c in same], np.int64))
            yield n_words, int(hit.sum()), sorted({c["number"] for c in same}), _hit_spans(words, offsets, t, hit)


def _judge_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_verified(batch.column("text"), batch.column("near")))
        n_words, n_hit, numbers, spans = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id").cast(pa.int64()),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(numbers, pa.list_(pa.int64())),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ],
            names=["row", "doc_id", "n_words", "n_hit", "numbers", "spans"],
        )


_JUDGED = (
    "row long, doc_id long, n_words long, n_hit long, numbers array<long>, spans array<struct<first: int, last: int>>"
)


def _matched(lines: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` (row, text and more) with ``near``, the windows of equal hash; and the items of each window number.

    A window that stands in many documents or items is one row of the smaller side; a
    document's matches are at most one per word and size, but for equal hashes.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = items.mapInArrow(_item_windows, "window long, size int, phrase string, item string")
    items = stored(items.distinct(), "item-windows")
    known = items.select("window", "size", "phrase").distinct()
    known = stored(known.withColumn("number", F.monotonically_increasing_id()), "windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most 13
    windows = lines.select("row", "text").mapInArrow(
        _document_windows(sizes), "window long, size int, row long, at long"
    )
    near = windows.join(known, ["window", "size"]).groupBy("row").agg(
        F.collect_list(F.struct("at", "size", "number", "phrase")).alias("near")
    )
    owners = items.where("item IS NOT NULL").join(known, ["window", "size", "phrase"]).select("number", "item")
    return lines.join(near, "row", "left"), owners


def _joined(lines: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Findings by ``row`` from a shuffle of windows, for a benchmark too large to broadcast."""
    matched, owners = _matched(lines, benchmark)
    found = stored(matched.select("row", "doc_id", "text", "near").mapInArrow(_judge_joined, _JUDGED), "found")
    names = found.select("row", F.explode("numbers").alias("number")).join(owners, "number")
    names = names.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return found.join(names, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
    )


def _clean_joined(docs: DataFrame, benchmark: DataFrame, spans: bool) -> DataFrame:
    """``decontaminate`` by a shuffle of windows."""
    # Columns go by number inside, so that no name can clash.
    names = docs.columns
    lines = _numbered(docs.toDF(*(f"c{i}" for i in range(len(names)))))
    text = f"c{names.index('text')}"
    matched, _ = _matched(lines.withColumnRenamed(text, "text"), benchmark)
    kept = [c if c != text else "text" for c in lines.columns if c != "row"]
    plain = matched.select(*kept, "near")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("text")
        for batch in batches:
            texts, near = batch.column(at), batch.column("near")
            found = list(_verified(texts, near))
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names=kept)
            if spans:
                cut = [t if t is None else _cut(t, f[3]) for t, f in zip(texts.to_pylist(), found)]
                own = own.set_column(at, "text", pa.array(cut, texts.type))
                yield own
            else:
                yield own.filter(pa.array([not _contaminated(f[1], f[0]) for f in found], pa.bool_()))

    return plain.mapInArrow(clean, plain.drop("near").schema).toDF(*names)


def _contaminated(n_hit, n_words):
    """The verdict on numbers, arrays or columns."""
    return (n_hit > 0) & (CONTAMINATED_PART * n_hit >= n_words)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a fixed number each, which repeated ids do not give."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _broadcast_windows(benchmark: DataFrame, max_windows: int):
    """The broadcast window set, or None if it may exceed ``max_windows``."""
    most = benchmark.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    if most > max_windows:  # no text has more windows than characters
        return None
    items = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast(WindowSet(items, WINDOW))


def findings(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items met, and hit spans in code points."""
    known = _broadcast_windows(benchmark, max_windows)
    if known is None:
        return _joined(_numbered(docs.select("doc_id", "text")), benchmark).drop("row")
    return docs.select("doc_id", "text").mapInArrow(_scan(known), _FINDINGS)


def judged(found: DataFrame) -> DataFrame:
    """Findings with the verdict."""
    return found.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, spans: bool = False, max_windows: int = MAX_BROADCAST_WINDOWS
) -> DataFrame:
    """Documents without the contaminated ones or, with ``spans``, all documents without hit spans.

    Columns are those of ``docs``. One pass: texts meet the window set where they lie,
    unless the benchmark is too large to broadcast.
    """
    known = _broadcast_windows(benchmark, max_windows)
    if known is None:
        return _clean_joined(docs, benchmark, spans)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(known)
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"]
            )
            found = pa.Table.from_batches(list(scan(iter([plain])))) if batch.num_rows else None
            if found is None:
                continue
            n_hit, n_words = found["n_hit"].to_numpy(), found["n_words"].to_numpy()
            if not spans:
                yield batch.filter(pa.array(~_contaminated(n_hit, n_words)))
                continue
            texts = batch.column(at).to_pylist()
            for i in np.flatnonzero(n_hit):
                texts[i] = _cut(texts[i], found["spans"][int(i)].as_py())
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = judged(findings(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (g, k)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits))
  GROUP BY doc_id
),
met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""

"""Substring dedup by level-wise doubling of repeated windows.

A window of ``min_words`` words that stands in two documents consists of shorter windows
that do. Lengths therefore double from a short one up to ``min_words`` (13: 7, then 13),
and only windows repeated at one length are extended to the next, until no candidates
survive. ``longest`` goes on doubling beyond ``min_words`` in the same way.

1.  Short levels only choose. Each window of ``min_words`` words is represented by the
    smallest hash of the windows of the level's length inside it, so about one hash in
    four positions is counted, and equal windows are represented alike. A window whose
    representative stands only once is unique and goes.
    Equal texts are told by a digest and only their smallest id goes on to
    the last level: the others hold nothing that it does not hold.
2.  The last level is exact: 64 and 32 bits of two hashes stand for the words of each
    window left, the smallest document id of each is found, and windows that a smaller id
    holds come back as places of their document.
3.  Words covered by such a window are the document's spans.

Hot groups: hashes are counted and minimised in the map tasks before they move; rows of
one hash meet their minimum in a join that adaptive execution splits. No list is gathered
but places within one document.

Defined cases: NULL and empty texts, and those of fewer words than a window, have no
spans; documents with NULL id neither lose words nor take them from others; rows that
repeat an id are separate documents of equal rank, and take nothing from each other;
extra columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table
from haberdash.llm.words import Words, mix, run_hash, signed, slices, split_words, unsigned

_U = np.uint64
MIN_WORDS = 13
# No level is shorter than this: shorter windows repeat by chance.
SHORTEST = 6
_SPANS = "array<struct<first: int, last: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def lengths(min_words: int) -> list[int]:
    """Window lengths, each at most twice the one before, that end in ``min_words``."""
    out = [min_words]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _starts(words: Words, size: int) -> np.ndarray:
    n = len(words.hash) - size + 1
    return np.flatnonzero(words.text[:n] == words.text[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def representatives(words: Words, at: np.ndarray, length: int, min_words: int) -> np.ndarray:
    """The smallest hash of ``length`` words in each window of ``min_words`` words from ``at``."""
    if not len(at):
        return np.zeros(0, _U)
    hashes = run_hash(words.hash, np.arange(len(words.hash) - length + 1), length)
    least = hashes[: len(words.hash) - min_words + 1].copy()
    for k in range(1, min_words - length + 1):
        np.minimum(least, hashes[k : k + len(least)], out=least)
    return least[at]


def _marked(words: Words, of: np.ndarray, values: np.ndarray, known: pa.Array) -> np.ndarray:
    """Which values are in the list of their text."""
    out = np.zeros(len(values), bool)
    cuts = np.searchsorted(of, np.arange(len(words.bounds)))
    lists, ends = unsigned(known.flatten().to_numpy()), np.concatenate([[0], np.cumsum(known.value_lengths())])
    for i in np.flatnonzero(np.diff(cuts)):
        out[cuts[i] : cuts[i + 1]] = np.isin(values[cuts[i] : cuts[i + 1]], lists[ends[i] : ends[i + 1]])
    return out


def _candidates(batch: pa.RecordBatch, before: int | None, min_words: int):
    """Words, and starts of the windows that survive, of each slice of a batch (row, text, known)."""
    for row, last, data, offsets in slices(batch.column(1)):
        words = split_words(data, offsets, lower=False)
        at = _starts(words, min_words)
        if before is not None:
            values = representatives(words, at, before, min_words)
            at = at[_marked(words, words.text[at], values, batch.column(2).slice(row, last - row))]
        yield batch.column(0).slice(row, last - row), words, at


def _chooser(length: int, before: int | None, min_words: int):
    """(hash, row) of the representatives of surviving windows."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, at in _candidates(batch, before, min_words):
                least, text = representatives(words, at, length, min_words), words.text[at]
                # Neighbouring windows mostly share theirs.
                fresh = np.ones(len(least), bool)
                fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(least[fresh])), rows.take(pa.array(text[fresh]))], names=["hash", "row"]
                )

    return choose


def _window_finder(before: int | None, size: int, min_words: int):
    """(hash, proof, row, place) of surviving windows of ``size`` words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, at in _candidates(batch, before, min_words):
                yield _window_rows(rows, words, at, size)

    return windows


def _window_rows(rows: pa.Array, words: Words, at: np.ndarray, size: int) -> pa.RecordBatch:
    text = words.text[at]
    proof = run_hash(mix(words.hash ^ _U(0x5851F42D4C957F2D)), at, size) >> _U(32)
    place = at - words.bounds[text]
    columns = [
        pa.array(signed(run_hash(words.hash, at, size))),
        pa.array(proof.astype(np.uint32).view(np.int32)),
        rows.take(pa.array(text)),
        pa.array(place.astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["hash", "proof", "row", "place"])


_WINDOW = "hash long, proof int, row long, place int"


def _longer_finder(length: int):
    """Windows of twice ``length`` from places whose windows, and those ``length`` on, are repeated."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, offsets in slices(batch.column(1)):
                words = split_words(data, offsets, lower=False)
                places = batch.column(2).slice(row, last - row)
                alive = np.zeros(len(words.hash) + length, bool)
                of = np.repeat(np.arange(last - row), places.value_lengths().to_numpy())
                alive[words.bounds[of] + places.flatten().to_numpy()] = True
                at = _starts(words, 2 * length)
                yield _window_rows(batch.column(0).slice(row, last - row), words, at[alive[at] & alive[at + length]], 2 * length)

    return windows


def _spans_of(places: np.ndarray, size: int) -> list[dict[str, int]]:
    """Word ranges covered by windows of ``size`` words from sorted ``places``."""
    cut = np.flatnonzero(np.diff(places) > size) + 1
    firsts, lasts = places[np.concatenate([[0], cut])], places[np.concatenate([cut - 1, [len(places) - 1]])] + size
    return [{"first": a, "last": b} for a, b in zip(firsts.tolist(), lasts.tolist())]


def _spanner(size: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_spans_of(np.unique(np.asarray(p)), size) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], names=["row", "spans"])

    return spans


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents under column numbers, which cannot clash, with a key of each row.

    With them their texts (row, text), and ids (row, doc_id) where the key is another.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    known = F.col(key).isNotNull() & (F.length(text) > 0)
    repeated = plain.where(known).groupBy(key).count().where("count > 1")
    if dict(plain.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") and not repeated.limit(1).count():
        # The id itself; rows without one have no part in any window.
        numbered, ids = plain.withColumn("row", F.col(key).cast("long")), None
    else:
        numbered = stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
        ids = numbered.where(known).select("row", F.col(key).alias("doc_id"))
    return numbered, numbered.where(known).select("row", F.col(text).alias("text")), ids


def _copies(texts: DataFrame, ids: DataFrame | None) -> DataFrame:
    """(row) of texts that a document with a smaller id holds as a whole; stored."""
    digests = _with_ids(texts.select("row", F.md5("text").alias("digest")), ids)
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stored(first.where("first < last").drop("last"), "first-copies")
    return stored(digests.join(first, "digest").where(F.col("doc_id") > F.col("first")).select("row"), "copies")


def _survivors(texts: DataFrame, min_words: int, copies: DataFrame | None = None) -> tuple[DataFrame, int | None]:
    """Rows (row, text, known) that may hold repeated windows, and the length of the hashes in ``known``.

    Rows of ``copies`` are counted at the first level only.
    """
    if copies is not None and len(lengths(min_words)) == 1:
        texts = texts.join(copies, "row", "left_anti")
    before = None
    for length in lengths(min_words)[:-1]:
        chosen = texts.mapInArrow(_chooser(length, before, min_words), "hash long, row long")
        repeated = stored(chosen.groupBy("hash").count().where("count > 1").select("hash"), f"repeated-{length}")
        back = chosen.join(repeated, "hash").groupBy("row").agg(F.collect_set("hash").alias("known"))
        if copies is not None:
            back = back.join(copies, "row", "left_anti")
        texts = texts.select("row", "text").join(stored(back, f"level-{length}"), "row")
        before = length
    return texts, before


def _with_ids(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    return rows.withColumn("doc_id", F.col("row")) if ids is None else rows.join(ids, "row")


def _held(windows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Windows (…, doc_id) that documents of several ids hold, with the smallest."""
    windows = _with_ids(windows, ids)
    first = windows.groupBy("hash", "proof").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # Stored, so that the join below starts from two plain exchanges and a hot window can be split.
    first = stored(first.where("first < last").drop("last"), "first-holders")
    return windows.join(first, ["hash", "proof"])


def repeated_places(texts: DataFrame, ids: DataFrame | None, min_words: int, copies: DataFrame) -> DataFrame:
    """(row, places): where windows start that a document with a smaller id holds too, but for ``copies``; stored."""
    survivors, before = _survivors(texts, min_words, copies)
    windows = survivors.mapInArrow(_window_finder(before, min_words, min_words), _WINDOW)
    later = _held(windows, ids).where(F.col("doc_id") > F.col("first"))
    return stored(later.groupBy("row").agg(F.collect_list("place").alias("places")), f"level-{min_words}")


def with_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with ``spans``: word ranges that windows of earlier documents cover, or NULL."""
    names = docs.columns
    numbered, texts, ids = _numbered(docs)
    copies = _copies(texts, ids)
    places = repeated_places(texts, ids, min_words, copies)
    spans = places.mapInArrow(_spanner(min_words), f"row long, spans {_SPANS}").withColumn("copy", F.lit(False))
    spans = spans.unionByName(copies.select("row", F.lit(None).cast(_SPANS).alias("spans"), F.lit(True).alias("copy")))
    text = f"c{names.index('text')}"
    n_words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    whole = F.array(F.struct(F.lit(0).alias("first"), n_words.alias("last")))
    spans_of = F.when(F.col("copy"), F.when(n_words >= min_words, whole)).otherwise(F.col("spans"))
    columns = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return numbered.join(spans, "row", "left").select(*columns, spans_of.alias("spans"))


def longest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, words): for each document with a window that another holds, the longest length of the doubling."""
    _, texts, ids = _numbered(docs)
    survivors, before = _survivors(texts, min_words)
    windows, size = survivors.mapInArrow(_window_finder(before, min_words, min_words), _WINDOW), min_words
    levels = []
    while True:
        held = _held(windows, ids).groupBy("row").agg(
            F.collect_list("place").alias("places"), F.first("doc_id").alias("doc_id"), F.lit(size).alias("words")
        )
        levels.append(stored(held, f"level-{size}"))
        if not levels[-1].limit(1).count():
            break
        again = texts.join(levels[-1].select("row", "places"), "row").select("row", "text", "places")
        windows, size = again.mapInArrow(_longer_finder(size), _WINDOW), 2 * size
    every = levels[0].select("doc_id", "row", "words")
    for level in levels[1:]:
        every = every.unionByName(level.select("doc_id", "row", "words"))
    return every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("words").alias("words")).drop("row")


def kept_mask(n_words: int, spans: list[dict[str, int]] | None) -> np.ndarray:
    kept = np.ones(n_words, bool)
    for span in spans or ():
        kept[span["first"] : span["last"]] = False
    return kept


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents whose texts have lost their spans; the words left are joined by one space."""
    names = docs.columns
    at = names.index("text")
    plain = with_spans(docs, min_words)
    plain = plain.toDF(*(f"c{i}" for i in range(len(names) + 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(names))
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                words = texts[i].encode().split()
                texts[i] = b" ".join(compress(words, kept_mask(len(words), spans[int(i)].as_py()))).decode()
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return plain.mapInArrow(cut, plain.drop(f"c{len(names)}").schema).toDF(*names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            # Splits at the white space of the contract.
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if spans.is_valid:
                mask = kept_mask(len(words), spans.as_py())
                words = list(compress(words, mask))
            n_removed.append(n_words[-1] - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words, removed words and the digest of the kept ones, for every document."""
    found = with_spans(table(spark, folder, "documents")).select("doc_id", "text", "spans")
    return found.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP11_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
    SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS words
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM split WHERE len(words) >= 13)
),
firsts AS (SELECT words, min(doc_id) AS first FROM windows GROUP BY words),
gone AS (
    SELECT DISTINCT doc_id, place + further AS place
    FROM windows JOIN firsts USING (words), range(13) AS steps(further) WHERE doc_id > first
),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split)
    ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

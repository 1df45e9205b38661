"""Katz backoff language model: Good-Turing discounted bigrams over a whole corpus.

A text is its words and one end token; the history of its first token is the end token.

    P(w | h) = d(r) r / c(h)        if the pair was seen r times in training text
             = alpha(h) P(w)        otherwise
    P(w)     = d(r) r / N           if the word was seen r times
             = what is left over    for the one class of unknown words

``d`` are Good-Turing discounts up to ``K`` and 1 beyond, of pairs and of words apart;
alpha(h) makes the probabilities after h add up to one over all words and the unknown
class. A history none of whose pairs is discounted is given one count more.

Neither texts nor model fit a task, and a row per token would cost more than all else, so
the work moves in packed blocks of numbers:

1.  Chunks. A task turns its texts into chunks of some million tokens: a dictionary of
    word hashes and token numbers into it. Stored.
2.  Words. Each dictionary is dealt by hash range to buckets; a bucket adds up its words
    over all chunks, gives each a number, and answers every chunk. Stored: the unigram
    table, one block per bucket, and the answers.
3.  Pairs. Each chunk deals its distinct pairs to buckets by history, with their counts; a
    bucket adds them up and answers. Stored: the bigram table, and the answers: a count
    per pair, and for histories of unseen pairs what alpha needs.
4.  Scores. Each chunk evaluates its tokens.

Hot keys: pairs are counted within a chunk before they move; the pairs of a history that
has more than one bucket's share of all tokens are dealt by word as well, and its parts
are added up in a table of at most one row per bucket. The number of buckets follows the
tokens. Words are told apart by 64-bit hashes.

Defined cases: NULL and empty texts are one end token; documents with NULL id are held
out; rows are kept one to one, repeated ids included; without training text the score is
that of the base measure; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table
from haberdash.llm.words import mix, slices, split_words

_U = np.uint64
K = 5
FOLDS, HELD_OUT = 7, 2
CHUNK_TOKENS = 1_500_000
# Tokens per bucket: a bucket's blocks fit a task.
BUCKET_TOKENS = 2_000_000
END = _U(0x656E64206F662074)

_CHUNKS = "chunk long, tokens_n long, ids binary, missing binary, held binary, bounds binary, tokens binary, words binary, train binary"
_WORD_ROWS = "kind string, bucket long, chunk long, payload binary"
_PAIR_ROWS = "kind string, bucket long, chunk long, payload binary, h long, n array<long>, s2 double"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, after their type and number."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    head = f"{values.dtype.str} {len(values)};".encode()
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    head, _, body = blob.partition(b";")
    kind, size = head.decode().split()
    dtype, size = np.dtype(kind), int(size)
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, size).T).view(dtype).ravel()


def pack_all(*arrays: np.ndarray) -> bytes:
    blobs = [pack(a) for a in arrays]
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def unpack_all(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        out.append(unpack(blob[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def least_type(values: np.ndarray) -> np.ndarray:
    """The values in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _chunker(chunk_tokens: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId(), 0
        ids, missing, held, sizes, hashes, total = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(hashes)
            words, tokens = np.unique(every, return_inverse=True)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            out = np.concatenate(held)
            training = np.repeat(~out, np.diff(bounds))
            train = np.bincount(tokens[training], minlength=len(words))
            blobs = [
                pack(np.concatenate(ids)),
                pack(np.concatenate(missing)),
                pack(out),
                pack(bounds),
                pack(least_type(tokens)),
                pack(words),
                pack(least_type(train)),
            ]
            row = [pa.array([(place << 32) + number]), pa.array([len(every)])]
            names = ["chunk", "tokens_n", "ids", "missing", "held", "bounds", "tokens", "words", "train"]
            return pa.RecordBatch.from_arrays(row + [pa.array([b], pa.binary()) for b in blobs], names=names)

        for batch in batches:
            for row, last, data, offsets in slices(batch.column("text")):
                words = split_words(data, offsets)
                n = np.diff(words.bounds)
                part = batch.column("doc_id").slice(row, last - row).cast(pa.int64())
                ids.append(part.fill_null(0).to_numpy())
                missing.append(part.is_null().to_numpy(zero_copy_only=False))
                held.append(batch.column("held_out").slice(row, last - row).to_numpy(zero_copy_only=False))
                sizes.append(n + 1)
                hashes.append(np.insert(words.hash, words.bounds[1:], END))
                total += len(hashes[-1])
                if total >= chunk_tokens:
                    yield flush()
                    number += 1
                    ids, missing, held, sizes, hashes, total = [], [], [], [], [], 0
        if sizes:
            yield flush()

    return chunks


def _ranges(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where the words of each bucket, a range of hashes, begin and end."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], dtype=_U)
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])


def _deal_words(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, train in zip(*(c.to_pylist() for c in batch.columns)):
                words, train = unpack(words), unpack(train)
                cuts = _ranges(words, buckets)
                rows = [
                    (b, chunk, pack_all(words[lo:hi], train[lo:hi]))
                    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]))
                    if hi > lo
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    names=["bucket", "chunk", "payload"],
                )

    return deal


def _kinds(counts: np.ndarray) -> np.ndarray:
    """How many things were counted 0, 1 … K + 1 times, and more often."""
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)


def _add_words(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    bucket = key[0].as_py()
    parts = [unpack_all(x) for x in group["payload"].to_pylist()]
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
    # Frequent words get small numbers.
    number = np.empty(len(words), np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    rows, at = [], 0
    for chunk, part in zip(group["chunk"].to_pylist(), parts):
        own = place[at : at + len(part[0])]
        at += len(own)
        rows.append(("answer", bucket, chunk, pack_all(least_type(number[own]), least_type(counts[own]))))
    rows.append(("unigrams", bucket, None, pack_all(words, least_type(counts))))
    rows.append(("sums", bucket, None, pack_all(np.append(_kinds(counts), counts.sum()))))
    return _table(rows, _WORD_ROWS)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    kinds["array<long>"] = pa.list_(pa.int64())
    columns = list(zip(*rows)) or [[]] * len(schema.split(", "))
    out = {}
    for column, declared in zip(columns, schema.split(", ")):
        name, kind = declared.split(" ")
        out[name] = pa.array(column, kinds[kind])
    return pa.table(out)


def discounts(kinds: np.ndarray) -> np.ndarray:
    """d(0) … d(K + 1) from numbers of things counted 0, 1 … K + 1 times.

    Where the Good-Turing estimate is not between 0 and 1, absolute discounting takes over.
    """
    n = kinds.astype(float)
    d = np.ones(K + 2)
    d[0] = 0
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    steady = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    for r in range(1, K + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        d[r] = (turing - common) / (1 - common) if common < 1 else -1.0
        if not 0 < d[r] < 1:
            d[r] = max(0.0, r - min(steady, 0.999)) / r
    return d


class Unigrams:
    """Probabilities of words by training count."""

    def __init__(self, kinds: np.ndarray, total: int) -> None:
        self.total, self.types = int(total), int(kinds[1:].sum())
        self.d = discounts(kinds)
        seen = np.arange(K + 2)
        lost = (kinds[: K + 2] * seen * (1 - self.d))[1:].sum()
        self.unknown = lost / total if total else 0.0
        self.plain = not self.unknown > 0  # no mass for unknown words: add one to all

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.types + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if self.plain:
            return self.base(counts)
        return np.where(counts > 0, self.d[np.minimum(counts, K + 1)] * counts / self.total, self.unknown)


class Chunk:
    """A chunk with the numbers and counts of its words."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes]], buckets: int) -> None:
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.bounds, self.held = unpack(row["bounds"]), unpack(row["held"])
        numbers, counts = [], []
        for bucket, payload in sorted(answers):
            number, count = unpack_all(payload)
            numbers.append(number.astype(np.int64) * buckets + bucket)
            counts.append(count.astype(np.int64))
        self.number, self.count = np.concatenate(numbers), np.concatenate(counts)
        self.end = int(self.tokens[self.bounds[1] - 1])

    def pairs(self, total: int, buckets: int) -> None:
        """Distinct pairs in the order of bucket, history and word."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.bounds[:-1]] = self.end
        width = len(self.number)
        keys, self.pair_of = np.unique(before * width + self.tokens, return_inverse=True)
        h, w = keys // width, keys % width
        training = np.repeat(~self.held, np.diff(self.bounds))
        train = np.bincount(self.pair_of[training], minlength=len(keys))
        self.hot = self.count * buckets > total
        of_h = (mix(self.number.astype(_U)) % _U(buckets)).astype(np.int64)
        of_both = mix(self.number[h].astype(_U) * _U(0x9E3779B97F4A7C15) + self.number[w].astype(_U)) % _U(buckets)
        bucket = np.where(self.hot[h], of_both.astype(np.int64), of_h[h])
        order = np.lexsort((self.number[w], self.number[h], bucket))
        self.h, self.w, self.train, self.bucket = h[order], w[order], train[order], bucket[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_of = place[self.pair_of]

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """Bucket, first pair and end."""
        starts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]]))
        for lo, hi in zip(starts, np.append(starts[1:], len(self.bucket))):
            yield int(self.bucket[lo]), int(lo), int(hi)


def _histories(h: np.ndarray) -> np.ndarray:
    """Where runs of equal histories begin."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def _chunk_of(left: pa.Table, right: pa.Table, buckets: int) -> tuple[dict, Chunk, list[tuple[int, bytes]]]:
    row = left.to_pylist()[0]
    answers = list(zip(*(right[c].to_pylist() for c in ("step", "bucket", "payload"))))
    chunk = Chunk(row, [(b, p) for s, b, p in answers if s == 0], buckets)
    return row, chunk, [(b, p) for s, b, p in answers if s == 1]


def _ask_pairs(word_buckets: int, buckets: int, total: int):
    def ask(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row, chunk, _ = _chunk_of(left, right, word_buckets)
        chunk.pairs(total, buckets)
        out = []
        for bucket, lo, hi in chunk.by_bucket():
            h, w = chunk.h[lo:hi], chunk.w[lo:hi]
            runs = _histories(h)
            sizes = np.diff(np.append(runs, hi - lo))
            payload = pack_all(
                least_type(chunk.number[h[runs]]),
                least_type(sizes),
                chunk.hot[h[runs]],
                least_type(chunk.number[w]),
                least_type(chunk.train[lo:hi]),
                least_type(chunk.count[w]),
            )
            out.append((bucket, key[0].as_py(), payload))
        return _table(out, "bucket long, chunk long, payload binary")

    return ask


def _add_pairs(unigrams: Unigrams):
    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [unpack_all(x) for x in group["payload"].to_pylist()]
        histories, h_of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        followers = np.concatenate([p[1] for p in parts]).astype(np.int64)
        words, w_of = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        keys, place = np.unique(np.repeat(h_of, followers) * len(words) + w_of, return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[4] for p in parts]), len(keys)).astype(np.int64)
        word_count = np.zeros(len(keys), np.int64)
        word_count[place] = np.concatenate([p[5] for p in parts])
        h = keys // len(words)
        hot = np.zeros(len(histories), bool)
        hot[h_of] = np.concatenate([p[2] for p in parts])
        seen = counts > 0
        n = np.stack([np.bincount(h[counts == r], minlength=len(histories)) for r in range(1, K + 1)], axis=1)
        s2 = np.bincount(h[seen], unigrams(word_count[seen]), len(histories))
        rows, at, at_h = [], 0, 0
        for chunk, part in zip(group["chunk"].to_pylist(), parts):
            own = counts[place[at : at + len(part[3])]]
            own_h = h_of[at_h : at_h + len(part[0])]
            runs = np.repeat(np.arange(len(own_h)), part[1].astype(np.int64))
            unseen = np.unique(runs[own == 0])
            ask = own_h[unseen]
            payload = pack_all(
                least_type(own),
                n[own_h].sum(axis=1) > 0,
                least_type(unseen),
                least_type(n[ask].ravel()),
                s2[ask],
            )
            rows.append(("answer", bucket, chunk, payload, None, None, None))
            at, at_h = at + len(part[3]), at_h + len(part[0])
        for i in np.flatnonzero(hot):
            rows.append(("hot", bucket, None, None, int(histories[i]), n[i].tolist(), float(s2[i])))
        model = pack_all(
            histories, least_type(np.bincount(h[seen], minlength=len(histories))), words[(keys % len(words))[seen]], least_type(counts[seen])
        )
        rows.append(("bigrams", bucket, None, model, None, None, None))
        rows.append(("sums", bucket, None, pack_all(_kinds(counts)), None, None, None))
        return _table(rows, _PAIR_ROWS)

    return add


def _evaluate(word_buckets: int, buckets: int, unigrams: Unigrams, d: np.ndarray, hot_rows: list[tuple]):
    hot_rows = sorted(hot_rows)
    hot_number = np.array([r[0] for r in hot_rows], np.int64)
    hot_n = np.array([r[1] for r in hot_rows], np.int64).reshape(-1, K)
    hot_s2 = np.array([r[2] for r in hot_rows], float)

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row, chunk, answers = _chunk_of(left, right, word_buckets)
        chunk.pairs(unigrams.total, buckets)
        answers = dict(answers)
        size = len(chunk.h)
        seen = np.zeros(size, np.int64)
        lost = np.zeros(len(chunk.number), bool)  # histories with discounted pairs
        mass = np.zeros(len(chunk.number))
        s2 = np.zeros(len(chunk.number))
        weight = np.arange(1, K + 1) * (1 - d[1 : K + 1])
        for bucket, lo, hi in chunk.by_bucket():
            own, any_lost, unseen, n, part = unpack_all(answers[bucket])
            seen[lo:hi] = own
            h = chunk.h[lo:hi]
            h = h[_histories(h)]
            lost[h] = any_lost
            ask = h[unseen.astype(np.int64)]
            mass[ask] = n.reshape(-1, K) @ weight
            s2[ask] = part
        if len(hot_number):
            at = np.minimum(np.searchsorted(hot_number, chunk.number), len(hot_number) - 1)
            hot = hot_number[at] == chunk.number
            lost[hot] = hot_n[at[hot]].sum(axis=1) > 0
            mass[hot] = hot_n[at[hot]] @ weight
            s2[hot] = hot_s2[at[hot]]
        single = unigrams(chunk.count)
        h, w = chunk.h, chunk.w
        count = chunk.count[h]
        whole = np.maximum(count + ~lost[h], 1)  # one count more where nothing is discounted
        alpha = np.where(lost[h], mass[h], 1) / whole / np.maximum(1 - s2[h], 1e-12)
        backed = np.where(count > 0, alpha, 1) * single[w]
        p = np.where(seen > 0, d[np.minimum(seen, K + 1)] * seen / whole, backed)
        with np.errstate(divide="ignore"):
            value = np.log10(p)[chunk.pair_of]
        base = np.log10(unigrams.base(chunk.count))[chunk.tokens]
        known = (chunk.count > 0)[chunk.tokens]
        starts = chunk.bounds[:-1]
        return pa.table(
            {
                "doc_id": pa.array(unpack(row["ids"]), pa.int64(), mask=unpack(row["missing"])),
                "held_out": pa.array(chunk.held),
                "n_tokens": pa.array(np.diff(chunk.bounds), pa.int64()),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(value, starts)),
            }
        )

    return score


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Per document: tokens, known tokens, base score and log10 probability under the model.

    ``docs`` has doc_id, text and held_out; the model learns from the rows not held out.
    """
    texts = docs.select("doc_id", "held_out", "text")
    chunks = stored(texts.mapInArrow(_chunker(chunk_tokens), _CHUNKS), "chunks")
    tokens = chunks.agg(F.sum("tokens_n").alias("n")).first()["n"] or 0
    buckets = max(1, -(-tokens // bucket_tokens))
    dealt = chunks.select("chunk", "words", "train").mapInArrow(
        _deal_words(buckets), "bucket long, chunk long, payload binary"
    )
    words = stored(dealt.groupBy("bucket").applyInArrow(_add_words, _WORD_ROWS), "words", by=["kind"])
    sums = np.zeros(K + 4, np.int64)
    # One short row per bucket.
    for row in words.where("kind = 'sums'").select("payload").toLocalIterator():
        sums += unpack_all(bytes(row["payload"]))[0]
    unigrams = Unigrams(sums[:-1], sums[-1])
    first = words.where("kind = 'answer'").select("chunk", F.lit(0).alias("step"), "bucket", "payload")
    asked = (
        chunks.select("chunk", "bounds", "held", "tokens")
        .groupBy("chunk")
        .cogroup(first.groupBy("chunk"))
        .applyInArrow(_ask_pairs(buckets, buckets, unigrams.total), "bucket long, chunk long, payload binary")
    )
    pairs = stored(asked.groupBy("bucket").applyInArrow(_add_pairs(unigrams), _PAIR_ROWS), "pairs", by=["kind"])
    kinds = np.zeros(K + 3, np.int64)
    for row in pairs.where("kind = 'sums'").select("payload").toLocalIterator():
        kinds += unpack_all(bytes(row["payload"]))[0]
    hot = pairs.where("kind = 'hot'").groupBy("h").agg(
        F.array(*(F.sum(F.col("n")[i]) for i in range(K))).alias("n"), F.sum("s2").alias("s2")
    )
    hot_rows = [(r["h"], r["n"], r["s2"]) for r in hot.collect()]  # at most one per bucket
    answers = first.unionByName(
        pairs.where("kind = 'answer'").select("chunk", F.lit(1).alias("step"), "bucket", "payload")
    )
    return (
        chunks.select("chunk", "bounds", "held", "tokens", "ids", "missing")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_evaluate(buckets, buckets, unigrams, discounts(kinds), hot_rows), _SCORES)
        .withColumn("train_tokens", F.lit(unigrams.total).cast("long"))
    )


def op4_katz(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(True))
    return scores(table(spark, folder, "documents").withColumn("held_out", held))

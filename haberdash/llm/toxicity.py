"""Toxicity by compression: what a dictionary of toxic text saves, window by window.

Two zstandard dictionaries are trained on a bounded sample of labelled rows. One holds
ordinary text. The other is trained on words with a stem, their first ``STEM`` letters,
that at least ``MIN_SHARE`` of the toxic sample holds and that is ``MIN_LIFT`` times as
frequent there as in the ordinary one; it is put before the ordinary content, so that
both explain ordinary text alike. Each
window of ``WINDOW`` words is compressed with both; the bytes saved are summed up per
document, and a logistic curve fitted on the other half of the sample turns them into a
probability, with the class sizes of all labelled rows.

The sample is at most ``SAMPLE`` documents of each class, of smallest hash, read and scored
whole, by tasks: the driver gets the telling stems, at most ``DICTIONARY_WINDOWS`` windows
of each class, of smallest hash, to train dictionaries, and some numbers a document.

Defined cases: NULL and empty texts are scored like a text without any saving; labels
that are NULL, or of NULL or unknown documents, teach nothing, and of repeated labels
the largest counts, of repeated documents the smallest text; without labels of both classes the score is the share of toxic
labels (0 without labels); NULL ids are kept and count as held out; rows are kept one
to one; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table

SAMPLE = 4000
WINDOW = 32
# Windows that train a dictionary, of so many characters at most.
DICTIONARY_WINDOWS = 20_000
WINDOW_CHARS = 4096
ORDINARY_BYTES = 16384
TOXIC_BYTES = 1024
LEVEL = 6
STEM = 4
MIN_SHARE = 0.02
MIN_LIFT = 4.0
THRESHOLD = 0.5
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")
# A trained dictionary starts with entropy tables; only its content is used.
_MIN_TRAINING = 50


def windows(text: str) -> list[bytes]:
    return _pieces(text.lower().split())


def _pieces(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


def _content(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of a dictionary trained on the samples, or their start if they are too few to train."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=k, d=6 if k < 32 else 8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]
    return trained[len(trained) - min(len(trained), size * 7 // 8) :]


@dataclass
class Model:
    """Contents of both dictionaries, and the curve from savings to a probability."""

    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def open(self) -> None:
        self._plain = _compressor(self.ordinary)
        self._telling = _compressor(self.toxic + self.ordinary)

    def features(self, text: str) -> list[float]:
        plain, telling = self._plain, self._telling
        saved = [len(plain.compress(w)) - len(telling.compress(w)) for w in windows(text)]
        saved = np.array(saved or [0.0], float)
        best = np.sort(saved)[::-1]
        clipped = np.clip(saved, 0, 12)
        return [
            best[0],
            best[:3].mean(),
            saved.mean(),
            clipped.mean(),
            (clipped**2).mean(),
            (saved >= 2).mean(),
            (saved >= 4).mean(),
            best[0] / np.log1p(len(saved)),
            np.log(len(saved)),
        ]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([self.features(t or "") for t in texts]).reshape(len(texts), -1)
        return _curve(_standard(x, self.centre, self.scale) @ self.weights)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=256,
        dict_size=ORDINARY_BYTES + TOXIC_BYTES,
        min_match=4,
        write_checksum=0,
        write_content_size=0,
        write_dict_id=0,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[(x - centre) / scale, np.ones(len(x))]


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a logistic curve; ``share``: of the class 1 among all rows."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = _standard(x, centre, scale)
    each = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    weights = np.zeros(z.shape[1])
    penalty = 1e-2 * np.eye(z.shape[1])
    for _ in range(30):
        p = _curve(z @ weights)
        slope = z.T @ (each * (p - y)) + penalty @ weights
        weights -= np.linalg.solve((z.T * (each * p * (1 - p))) @ z + penalty, slope)
    return centre, scale, weights


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic) of each stem of each document."""
    for batch in batches:
        stems, classes = [], []
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            found = {w[:STEM] for w in _WORD.findall(text.as_py().lower())}
            stems += found
            classes += [toxic] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(classes, pa.int32())], names=["stem", "toxic"])


def _telling_stems(rows: DataFrame, sizes: dict[int, int]) -> set[str]:
    """Stems of the toxic texts that the ordinary ones hardly hold: those of a ``MIN_SHARE`` of texts at least."""
    n, m = sizes[1], sizes[0]
    counts = rows.select("text", "toxic").mapInArrow(_stem_rows, "stem string, toxic int").groupBy("stem")
    counts = counts.agg(F.sum("toxic").alias("inside"), F.sum(1 - F.col("toxic")).alias("outside"))
    often = F.col("inside") >= max(2, MIN_SHARE * n)
    apart = F.col("inside") / n >= MIN_LIFT * (F.col("outside") + 1) / m
    return {r["stem"] for r in counts.where(often & apart).select("stem").collect()}


def _window_rows(telling: set[str]):
    """(toxic, window): all of ordinary texts, of toxic ones those of their words with a telling stem."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, classes = [], []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py().lower()
                own = _pieces([w for w in _WORD.findall(text) if w[:STEM] in telling]) if toxic and telling else windows(text)
                found += own
                classes += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(found, pa.binary())], names=["toxic", "window"])

    return cut


def _drawn_windows(rows: DataFrame, telling: set[str]) -> dict[int, list[bytes]]:
    """At most ``DICTIONARY_WINDOWS`` windows of each class, by hash."""
    every = rows.select("text", "toxic").mapInArrow(_window_rows(telling), "toxic int, window binary")
    every = stored(every.where(F.length("window") <= WINDOW_CHARS), "toxicity-windows")
    drawn = {}
    for kind in (0, 1):
        own = every.where(F.col("toxic") == kind).orderBy(F.xxhash64("window"), "window").limit(DICTIONARY_WINDOWS)
        drawn[kind] = [bytes(r["window"]) for r in own.select("window").collect()] or [b" "]
    return drawn


def _feature_rows(model: Model):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for batch in batches:
            found = [model.features(text.as_py()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    return features


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    chosen = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)
    ]
    # At most twice the sample size of ids.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # Halves: one for the dictionaries, one for the curve.
    texts = stored(texts.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "toxicity-sample")
    counts = {(r["half"], r["toxic"]): r["count"] for r in texts.groupBy("half", "toxic").count().collect()}
    nothing = np.zeros(0)
    if {y for _, y in counts} != {0, 1}:
        return Model(b"", b"", nothing, nothing, nothing, float(share))
    if len(counts) == 4:
        for_words, for_curve = (texts.where(F.col("half") == h) for h in (0, 1))
        each = {y: counts[0, y] for y in (0, 1)}
    else:
        for_words = for_curve = texts
        each = {y: sum(n for (_, kind), n in counts.items() if kind == y) for y in (0, 1)}
    drawn = _drawn_windows(for_words, _telling_stems(for_words, each))
    contents = _content(drawn[0], ORDINARY_BYTES, 64), _content(drawn[1], TOXIC_BYTES, 24)
    model = Model(*contents, nothing, nothing, nothing)
    rows = for_curve.select("text", "toxic").mapInArrow(_feature_rows(model), "toxic int, x array<double>").collect()
    rows = sorted((r["toxic"], r["x"]) for r in rows)
    x, y = np.array([x for _, x in rows]), np.array([y for y, _ in rows])
    model.centre, model.scale, model.weights = _fit_curve(x, y, share)
    return model


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.constant is None:
            model.open()
        for batch in batches:
            scores = pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), scores], names=["doc_id", "score"]
            )

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: score, verdict, and whether the model may not have seen it."""
    found = docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return found.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Documents scored below the threshold, all columns kept."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.constant is None:
            model.open()
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, fit(docs, table(spark, folder, "labels")))

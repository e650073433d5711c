"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is compressed in blocks with either dictionary and with none. The normalised difference of the two sizes says which
kind of text it is closer to; together with the sizes themselves (which show junk that repeats itself) it is calibrated
to a probability by logistic regression on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, crc_mod, fit_sample, map_batches, place, text_bytes

BLOCK = 2048
#: Bounds of the sample to fit on: documents of each label, bytes of one document.
PER_CLASS, MOST_BYTES = 1500, 1 << 16
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
RESULT = "score double, predicted int"


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass
class Model:
    """Dictionaries (None where there was too little text), and weights over the standardised features."""

    good: bytes | None
    bad: bytes | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad, None):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = _expanded((features - self.mean) / self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -35, 35)))


def features(text: bytes | None, compressors: list) -> tuple[float, ...]:
    """Normalised size difference; sizes with no, the bad and the good dictionary per byte; log length. Over all blocks."""
    blocks = _blocks(text or b"")
    good, bad, none = (sum(len(c.compress(x)) for x in blocks) for c in compressors)
    n = max(1, len(text or b""))
    return (bad - good) / max(1, bad + good), none / n, bad / n, good / n, float(np.log(n))


def _expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    return np.c_[x, x**2, x[:, :1] * x[:, 1:], np.ones(len(x))]


def _dictionary(texts: list[bytes]) -> bytes | None:
    blocks = [b for t in texts for b in _blocks(t)]
    for size in (DICTIONARY_BYTES, DICTIONARY_BYTES // 4, DICTIONARY_BYTES // 16):
        if sum(map(len, blocks)) >= 8 * size:
            try:
                return zstandard.train_dictionary(size, blocks).as_bytes()
            except zstandard.ZstdError:
                continue
    return None


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """labels: (doc_id, quality 0 or 1); other values and nulls are passed over, as are doc_ids with both labels. Half of the
    sample (per_class documents of each label, of most_bytes at most) makes the dictionaries, the other half the
    calibration, weighted to the shares that the labels have in the whole table. Without labels of both kinds
    every score is the smoothed share of good labels."""
    labelled = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = sorted((r["doc_id"], r["text"].encode(), r["label"]) for r in fit_sample(docs, labelled, per_class, most_bytes).collect())
    rows = [(t, y) for _, t, y in rows]
    dicts = [_dictionary([t for i, (t, y) in enumerate(rows) if y == k and i % 2 == 0]) for k in (1, 0)]
    prior = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    model = Model(*dicts, np.zeros(5), np.ones(5), np.zeros(15), prior)
    model.weights[-1] = np.log(prior / (1 - prior))
    rest = rows[1::2]
    y = np.array([k for _, k in rest], float)
    if len(set(y)) < 2:
        return model
    compressors = model.compressors()
    x = np.array([features(t, compressors) for t, _ in rest])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = _expanded((x - model.mean) / model.scale)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-5 * np.eye(z.shape[1])
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-5 * w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def _scorer(docs: DataFrame, model: Model):
    """A function from a batch to the scores of its rows, for use in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)

    def scorer():
        own = Model(**shared.value)
        compressors = own.compressors()
        return lambda batch: own.scores(np.array([features(t, compressors) for t in text_bytes(batch.column(place(batch.schema.names, "text")))]).reshape(-1, 5))

    return scorer


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, any other columns) with score and predicted (1 if score >= 0.5).

    Null and empty texts get the score that their length 0 has under the model; very long texts are compressed block by block, as
    a whole. Rows are judged one by one: equal texts get equal scores, repeated rows repeat, an empty table gives an empty
    result. Columns with the names of results are replaced, others, however named, come back unchanged. No shuffle.
    """
    scorer, schema = _scorer(docs, model), appended(docs.schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer()
        for batch in batches:
            s = scores(batch)
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name.lower() not in ("score", "predicted")]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[n for n, _ in kept] + ["score", "predicted"])

    return map_batches(docs, run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Fit on `labels` and score docs."""
    return score(docs, fit(docs, labels, **bounds))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """docs without those that the classifier rejects (score under 0.5). All columns of the rest, those named like results
    too, come back unchanged; odd texts as in score(); an empty table gives an empty one."""
    scorer = _scorer(docs, fit(docs, labels, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) >= 0.5))

    return map_batches(docs, run, docs.schema)


def fold(labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """The labels to learn from: those whose crc32(doc_id as text) leaves another remainder."""
    return labels.where(crc_mod("doc_id", modulus) != held)

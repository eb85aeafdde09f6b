"""Quality classifier on supervised subword embeddings.

Every word, every pair of neighbouring words and every character n-gram of a document is hashed to
a bucket that has a learned vector. A document is the average of its vectors and a softmax layer
turns it into class probabilities. Vectors and layer are trained by stochastic gradient descent
in numpy. As everything after the lookup is linear, a trained model keeps one number for each
bucket: its vector times the difference of the two output rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequern.llm._shared import only
from pagequern.llm._text import _LOWER, _SPACE, byte_sums, mix64, near_copies, range_hash, text_chunks, words

#: Labelled rows to learn from, at most, the first by hash of their id, and the longest text among them.
LEARN_ROWS, LEARN_CHARS = 5_000, 100_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 8, 8, 0.5
#: Bytes of character n-grams.
GRAMS = (3, 5)


@dataclass(frozen=True)
class Model:
    #: float32 of each bucket
    gains: bytes
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of every text, in no order."""
    start, _, hashes, first = words(data, offsets)
    n = len(offsets) - 1
    of_word = np.repeat(np.arange(n), np.diff(first))
    found = [(hashes, of_word)]
    if len(hashes) > 1:
        # the difference is 0, whatever the word, if a word is repeated
        pair = mix64(hashes[1:] - hashes[:-1] + np.uint64(1))
        together = of_word[1:] == of_word[:-1]
        found.append((pair[together], of_word[1:][together]))
    plain = np.where(_SPACE[data], np.uint8(32), _LOWER[data])
    sums, of_byte = byte_sums(plain), np.repeat(np.arange(n), np.diff(offsets))
    for gram in GRAMS:
        at = np.arange(max(len(plain) - gram + 1, 0))
        at = at[of_byte[at] == of_byte[at + gram - 1]] if len(at) else at
        found.append((range_hash(sums, at, at + gram), of_byte[at]))
    buckets = np.concatenate([h for h, _ in found]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([t for _, t in found])


def scores(data: np.ndarray, offsets: np.ndarray, gains: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the good class of each text."""
    bucket, text = features(data, offsets)
    n = len(offsets) - 1
    mean = np.bincount(text, gains[bucket], n) / np.maximum(np.bincount(text, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30)))


def fit_texts(texts: pa.Array, good: np.ndarray, seed: int = 11) -> Model:
    """Near copies count once. Without both classes the score is the share of good rows."""
    keep = ~np.array(near_copies(texts), bool)
    texts, good = texts.filter(pa.array(keep)), good[keep]
    share = float(np.log((good.sum() + 0.5) / (len(good) - good.sum() + 0.5)))
    if not 0 < good.sum() < len(good):
        return Model(np.zeros(BUCKETS, np.float32).tobytes(), share)
    rows = []
    for _, _, data, offsets in text_chunks(texts):
        bucket, text = features(data, offsets)
        order = np.lexsort((bucket, text))
        bucket, ends = bucket[order], np.searchsorted(text[order], np.arange(len(offsets)))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own, count = np.unique(bucket[a:b], return_counts=True)
            rows.append((own, (count / max(b - a, 1)).astype(np.float32)))
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = random.normal(0, 0.3, (2, DIM)).astype(np.float32), np.array([0.0, share], np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(len(rows)).tolist():
            own, weight = rows[i]
            mean = weight @ vectors[own]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(good[i])] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # the rate of a vector follows how much of the text it stands for, up to its root
            vectors[own] -= (rate * 8) * np.sqrt(weight)[:, None] * np.sqrt(weight.mean() if len(weight) else 0) * back
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32).tobytes(), float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, learn_chars: int = LEARN_CHARS) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod 5 is not 0; null labels and texts are left out.

    The sample is bounded: learn_rows labels, the first by hash of the id, so that reruns agree.
    """
    known = only(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(learn_rows)
    texts = only(docs, "doc_id", "text").where(F.length("text") <= learn_chars)
    rows = texts.join(F.broadcast(sample), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("text", "ascending")])
    return fit_texts(rows.column("text").combine_chunks(), rows.column("quality").to_numpy().astype(np.int64))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """docs with a column of scores from 0 to 1; a null or empty text, or none, has no features and scores by the bias."""
    names = docs.columns
    if text_col not in names:
        return with_score(docs.withColumn(text_col, F.lit(None).cast("string")), model, text_col, name).drop(text_col)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.frombuffer(model.gains, np.float32)
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), pa.array(scores(data, offsets, gains, model.bias))], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from a score of least).

    Repeated rows score alike; empty input gives no rows; without labels of both classes every text
    scores the share of good ones. Other columns of docs are ignored.
    """
    found = with_score(only(docs, "doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= least).cast("int").alias("predicted"))

"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the ordinary documents and one on the toxic passages
of the toxic documents. A label is about a whole document, of which a few words are toxic, so the
passages are found first: words whose beginnings, or that as wholes, stand out in toxic documents.
The toxic side holds both dictionaries, so that windows of plain prose compress alike on either
side and the difference of the lengths, the gain, comes from toxic text alone. A document's score
is a logistic function of what its windows gain, calibrated on rows that the dictionaries haven't
seen.

The dictionaries are used without the entropy tables that the trainer puts before their content:
those differ from one to the other and would add differences that have nothing to do with the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequern.llm._shared import fresh, only
from pagequern.llm._text import _LOWER, byte_sums, near_copies, range_hash, text_chunks, words

#: Labelled rows to learn from, at most, the first by hash of their id, and the longest text among them.
LEARN_ROWS, LEARN_CHARS = 8_000, 100_000
#: Bytes of a window, about, and of each dictionary.
WINDOW, DICTIONARY = 56, 24_576
#: Gains in bytes that count, see gain_features().
GAINS = (1, 2, 3, 5)
#: Begins every window and ends every dictionary: a window then never falls back to a stored block, where gains don't show.
PRIMER = b"\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1d\x1e"
#: Ends every window, as no match is looked for in the last eight bytes.
TAIL = b" \x02\x04\x06\x08\x0f\x11\x13\x15\x17"
#: Bytes that are cut out as one, and compared, when a toxic dictionary is trained.
SEGMENT, PIECE = 24, 6
#: Lengths in bytes of the word beginnings that may mark toxic passages (0: whole words), and how often one counts in a text at most.
KINDS, TIMES = (0, 3, 4, 5, 6, 7, 8), 3
#: One that marks is so many times as frequent in toxic texts, and its test reaches so many times the logarithm of how many are tested.
LEAST_RATIO, LEAST_TEST = 6.0, 3.0
#: Bytes at a word's beginning that are written in capitals, see marked().
CAPITALS = 4
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    #: of gain_features()
    weights: tuple[float, ...]


def parameters() -> zstandard.ZstdCompressionParameters:
    """So short a window keeps its literals as they are, and a match shows with its whole length."""
    return zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=17, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )


class Compressor:
    """Compressed lengths of many byte ranges under one dictionary."""

    def __init__(self, content: bytes):
        given = zstandard.ZstdCompressionDict(content + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(compression_params=parameters())
        self._c = zstandard.ZstdCompressor(dict_data=given, compression_params=parameters())

    def lengths(self, data: bytes, parts: bytes) -> np.ndarray:
        """data and parts as primed() makes them."""
        if not parts:
            return np.zeros(0, np.int64)
        out = self._c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, parts), threads=1)
        return np.fromiter(map(len, map(out.__getitem__, range(len(out)))), np.int64, len(out))


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, but the beginnings of words in capitals: a match then tells how a word begins from what is within one."""
    out = _LOWER[data]
    start, end, _, _ = _bare_words(data, offsets)
    for i in range(CAPITALS):
        at = (start + i)[start + i < end]
        out[at] = _UPPER[out[at]]
    return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of windows that cover every word of every text: whole words, WINDOW bytes about."""
    start, end, _, first = words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    slot = (start - offsets[text]) // WINDOW
    new = np.ones(len(start), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else at, text[at]


def primed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, bytes]:
    """The ranges, each after PRIMER and before TAIL, in one buffer; their places in it as 64-bit pairs of offset and length."""
    length = end - start + len(PRIMER) + len(TAIL)
    new = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    for what, at in ((PRIMER, new), (TAIL, new + length - len(TAIL))):
        out[(at[:, None] + np.arange(len(what))).ravel()] = np.tile(np.frombuffer(what, np.uint8), len(new))
    own = np.repeat(new + len(PRIMER) - start, end - start)
    at = np.arange(len(own)) - np.repeat(np.cumsum(end - start) - end, end - start)
    out[at + own] = data[at]
    return out.tobytes(), np.stack([new, length], axis=1).astype(np.uint64).tobytes()


def window_gains(data: np.ndarray, offsets: np.ndarray, ordinary: Compressor, toxic: Compressor):
    """(gain, text, start, end) of each window: the bytes that the toxic dictionary saves."""
    start, end, text = windows(data, offsets)
    ranges = primed(marked(data, offsets), start, end)
    return ordinary.lengths(*ranges) - toxic.lengths(*ranges), text, start, end


def gain_features(data: np.ndarray, offsets: np.ndarray, ordinary: Compressor, toxic: Compressor) -> np.ndarray:
    """For each text: how many windows, 3 at most, reach each step of GAINS, the same by share of windows, and 1."""
    gain, text, _, _ = window_gains(data, offsets, ordinary, toxic)
    n = len(offsets) - 1
    all_windows = np.maximum(np.bincount(text, minlength=n), 1)
    reached = [np.bincount(text[gain >= least], minlength=n) for least in GAINS]
    return np.stack([*(np.minimum(r, 3) for r in reached), *(np.minimum(20 * r / all_windows, 3) for r in reached), np.ones(n)], axis=1)


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a dictionary trained on the samples; all of them if they are too few to train on."""
    try:
        trained = zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    # header and entropy tables come first and end with the three repeat offsets 1, 4, 8
    mark = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"
    content = trained[trained.find(mark) + len(mark) :] if mark in trained else b""
    return content or b"".join(samples)[-size:]


def _column_features(texts: pa.Array, ordinary: Compressor, toxic: Compressor) -> np.ndarray:
    return np.concatenate([np.zeros((0, 2 * len(GAINS) + 1)), *(gain_features(d, o, ordinary, toxic) for _, _, d, o in text_chunks(texts))])


def _bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, text) of each word without the punctuation at its edges."""
    start, end, _, first = words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    edge = np.append(_EDGE[data], False)
    while (more := (start < end) & edge[start]).any():
        start = start + more
    while (more := (start < end) & edge[end - 1]).any():
        end = end - more
    some = start < end
    start, end = start[some], end[some]
    return start, end, range_hash(byte_sums(_LOWER[data]), start, end), text[some]


def _beginnings(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hash, text, start, end) of the words by each kind of beginning that they have."""
    start, end, whole, text = _bare_words(data, offsets)
    sums = byte_sums(_LOWER[data])
    for n in KINDS:
        has = end - start >= n
        h = range_hash(sums, start[has], start[has] + n) if n else whole
        yield n, h, text[has], start[has], end[has]


def _times(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, times that they occur), TIMES of a text at most."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    found, which = np.unique(h[at], return_inverse=True)
    return found, np.bincount(which, np.minimum(np.diff(at, append=len(h)), TIMES), len(found)).astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)]), return_inverse=True)
    return h, np.bincount(which, np.concatenate([np.zeros(0), *(p[1] for p in parts)]), len(h)).astype(np.int64)


def marks(texts: pa.Array, toxic: np.ndarray) -> dict[int, np.ndarray]:
    """For each kind of beginning the sorted hashes that tell toxic texts apart.

    One can mark if the likelihood ratio test of how often the classes have it stands out among as many,
    and it is LEAST_RATIO times as frequent in toxic texts. Where one begins another, the surer one marks.
    """
    own, others = (list(text_chunks(texts.filter(pa.array(toxic == c)))) for c in (1, 0))
    n_plain, n_toxic = max(int((toxic == 0).sum()), 1), max(int(toxic.sum()), 1)
    seen: dict[int, list] = {n: [] for n in KINDS}
    for _, _, data, offsets in own:
        for n, h, text, _, _ in _beginnings(data, offsets):
            seen[n].append(_times(h, text))
    counted = {n: _added(parts) for n, parts in seen.items()}
    least = {n: LEAST_TEST * np.log(len(h) + 2) for n, (h, _) in counted.items()}
    counted = {n: (h[c > TIMES], c[c > TIMES]) for n, (h, c) in counted.items()}  # a single text doesn't make a mark
    against = {n: np.zeros(len(h), np.int64) for n, (h, _) in counted.items()}
    for _, _, data, offsets in others:
        for n, h, text, _, _ in _beginnings(data, offsets):
            hit = np.isin(h, counted[n][0])
            found, times = _times(h[hit], text[hit])
            against[n][np.searchsorted(counted[n][0], found)] += times
    tests: dict[int, dict[int, float]] = {}
    for n, (h, c) in counted.items():
        o = against[n]
        share = (c + o) / (n_plain + n_toxic)
        test = 2 * (c * np.log(c / (share * n_toxic)) + np.where(o > 0, o * np.log(np.maximum(o, 1) / (share * n_plain)), 0))
        can = (c * (n_plain + 1) >= LEAST_RATIO * (o + 0.5) * (n_toxic + 1)) & (test >= least[n])
        tests[n] = dict(zip(h[can].tolist(), test[can].tolist(), strict=True))
    spelled: dict[bytes, tuple[float, int, int]] = {}
    for _, _, data, offsets in own:
        for n, h, _, start, end in _beginnings(data, offsets):
            for i in np.flatnonzero(np.isin(h, np.array([*tests[n]], np.uint64))).tolist():
                said = _LOWER[data[start[i] : start[i] + n if n else end[i]]].tobytes() + b" " * (not n)
                spelled[said] = (tests[n][int(h[i])], n, int(h[i]))
    wanted: dict[int, list[int]] = {n: [] for n in KINDS}
    chosen: list[bytes] = []
    for said, (_, n, h) in sorted(spelled.items(), key=lambda x: (-x[1][0], x[0])):
        if not any(said.startswith(c) or c.startswith(said) for c in chosen):
            chosen.append(said)
            wanted[n].append(h)
    return {n: np.sort(np.array(h, np.uint64)) for n, h in wanted.items()}


def passages(data: np.ndarray, offsets: np.ndarray, wanted: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words that begin as marks() wants it."""
    found = [(start[hit], end[hit], text[hit]) for n, h, text, start, end in _beginnings(data, offsets) for hit in [np.isin(h, wanted[n])]]
    start, end, text = (np.concatenate([f[i] for f in found]) for i in range(3))
    start, first = np.unique(start, return_index=True)
    return start, end[first], text[first]


def toxic_samples(texts: pa.Array, wanted: dict[int, np.ndarray]) -> list[bytes]:
    """Of each text its passages, each after a space, as marked() writes them."""
    out = []
    for _, _, data, offsets in text_chunks(texts):
        said, (start, end, text) = marked(data, offsets), passages(data, offsets, wanted)
        for t in np.unique(text).tolist():
            out.append(b"".join(b" " + said[a:b].tobytes() for a, b in zip(start[text == t].tolist(), end[text == t].tolist(), strict=True)))
    return out


def without_passages(data: np.ndarray, offsets: np.ndarray, wanted: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts without their passages."""
    start, end, _ = passages(data, offsets, wanted)
    edges = np.zeros(len(data) + 1, np.int64)
    edges[start] += 1
    edges[end] -= 1
    stay = np.cumsum(edges[:-1]) == 0
    return data[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * len(x) * np.eye(len(w)) / 100, x.T @ (p - y) + penalty * len(x) * w / 100)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dictionaries(texts: pa.Array, toxic: np.ndarray) -> tuple[bytes, bytes]:
    """Contents for either side.

    Passages that mark toxic texts are no ordinary text wherever they stand. Ordinary windows that
    gain all the same are added to both sides, those that gain most first, so that they gain no more.
    """
    wanted = marks(texts, toxic)
    plain = [without_passages(data, offsets, wanted) for _, _, data, offsets in text_chunks(texts.filter(pa.array(toxic == 0)))]
    samples = [said[a:b].tobytes() for data, offsets in plain for said in [marked(data, offsets)] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    base = _trained([x[i : i + 4096] for x in samples for i in range(0, len(x), 4096) if len(x) - i >= 8], DICTIONARY)
    own = _trained(toxic_samples(texts.filter(pa.array(toxic > 0)), wanted), DICTIONARY, k=SEGMENT, d=PIECE)
    before, after, hard = Compressor(base), Compressor(own + base), {}
    for data, offsets in plain:
        gain, _, start, end = window_gains(data, offsets, before, after)
        said = marked(data, offsets)
        for i in np.flatnonzero(gain > 0).tolist():
            hard[said[start[i] : end[i]].tobytes()] = int(gain[i])
    order = sorted(hard.items(), key=lambda x: (-x[1], x[0]))
    room = np.cumsum([len(w) + 1 for w, _ in order]) <= DICTIONARY
    kept = b"\n".join(w for (w, _), fits in zip(order[::-1], room[::-1], strict=True) if fits)
    return kept + base, own + kept + base


def fit_texts(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The dictionaries come from all rows; the calibration from halves scored with the other half's dictionaries.

    Copies and near copies count once. With fewer than four distinct texts of either class the
    score is the share of toxic rows for every text.
    """
    first = ~np.array(near_copies(texts), bool)
    texts, toxic = texts.filter(pa.array(first)), toxic[first]
    if not 4 <= toxic.sum() <= len(toxic) - 4:
        share = float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)))
        return Model(b"", b"", (*[0.0] * 2 * len(GAINS), share))
    x = np.zeros((len(toxic), 2 * len(GAINS) + 1))
    half = np.cumsum(toxic) % 2 == 0
    for own in (half, ~half):
        sides = map(Compressor, _dictionaries(texts.filter(pa.array(~own)), toxic[~own]))
        x[own] = _column_features(texts.filter(pa.array(own)), *sides)
    return Model(*_dictionaries(texts, toxic), tuple(_logistic(x, toxic.astype(float)).tolist()))


def learn(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, learn_chars: int = LEARN_CHARS) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod 3 is not 1; null labels and texts are left out.

    The sample is bounded: learn_rows labels, the first by hash of the id, so that reruns agree. One
    task learns from it, and only the model comes to the driver.
    """
    known = only(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(learn_rows)
    texts = only(docs, "doc_id", "text").where(F.length("text") <= learn_chars)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text").repartition(1)
    found = rows.mapInArrow(_trained_model, "ordinary binary, toxic binary, weights array<double>").first()
    return Model(bytes(found.ordinary), bytes(found.toxic), tuple(found.weights)) if found else fit_texts(pa.array([], pa.string()), np.zeros(0, np.int64))


def _trained_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample (doc_id, toxic, text) to one row with the model of it; the order of the sample doesn't count."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("toxic", "doc_id", "text")])
        mixed = np.random.default_rng(7).permutation(rows.num_rows)
        model = fit_texts(rows.column("text").combine_chunks().take(pa.array(mixed)), rows.column("toxic").to_numpy()[mixed])
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((model.ordinary, model.toxic, list(model.weights)), kinds, strict=True)], names=["ordinary", "toxic", "weights"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """docs with a column of scores from 0 to 1. Null and empty texts, and rows of a table without them, have no window and score as such."""
    names = docs.columns
    if text_col not in names:
        return with_score(docs.withColumn(text_col, F.lit(None).cast("string")), model, text_col, name).drop(text_col)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic, weights = Compressor(model.ordinary), Compressor(model.toxic), np.array(model.weights)
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(at)):
                score = 1 / (1 + np.exp(-np.clip(gain_features(data, offsets, ordinary, toxic) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), pa.array(score)], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from a score of least).

    Repeated rows score alike; empty input gives no rows; with fewer than four labelled texts of
    either class every text scores the share of toxic ones. Other columns of docs are ignored.
    """
    found = with_score(only(docs, "doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= least).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs that score less than least, with all their columns, repeated rows and those without id or text too; none of an empty table."""
    name = fresh(docs, "__score")
    return with_score(docs, learn(docs, labels), name=name).where(F.col(name) < least).drop(name)

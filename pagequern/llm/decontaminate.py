"""Benchmark decontamination with SimHash windows.

A benchmark item of L words is looked for in every window of L words of a document; a document of
fewer words is one window. Windows and
items get 64-bit SimHash fingerprints of their weighted 5-word shingles. Multi-index blocks
guarantee every pair within the radius: of two fingerprints RADIUS apart, one of BLOCKS parts
differs in RADIUS // BLOCKS bits at most, so each part of an item is indexed with all values that
near. Candidates are then compared exactly by weighted Jaccard similarity.

A window that shares no shingle with an item has similarity 0, so only windows around a shared
shingle are fingerprinted; nothing else is skipped. Items travel to the executors in blocks of
bounded size, one pass for each; the documents are never shuffled.

Items of fewer words than a shingle have no fingerprint: they are found where a document is that
item and nothing else, by equal words. As runs in longer texts they would be in ordinary prose.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagequern.llm._shared import WORD, fresh, materialize, only, small
from pagequern.llm._text import mix64, shingles, text_chunks, words

#: Bits in which fingerprints of similar texts differ at most, and the blocks of the index.
RADIUS, BLOCKS = 17, 6
#: Words of all items in one broadcast, about: some 40 bytes each.
BROADCAST_WORDS = 1 << 20
#: Shingle positions that are fingerprinted at once.
_SPAN = 1 << 15
_BIT_ENDS = np.linspace(0, 64, BLOCKS + 1).astype(int)


class Items:
    """Benchmark items ready for search. Items of fewer than k words are in short, by their words' hashes."""

    def __init__(self, ids: list[int], texts: pa.Array, k: int):
        self.k, self.ids, self.size, self.lists = k, [], [], []
        self.short: dict[tuple[int, ...], list] = {}
        for row, _, data, offsets in text_chunks(texts):
            _, _, hashes, first = words(data, offsets)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), row):
                if b - a >= k:
                    self.ids.append(ids[i])
                    self.size.append(b - a)
                    self.lists.append(shingles(hashes[a:b], k))
                elif b > a:
                    self.short.setdefault(tuple(hashes[a:b].tolist()), []).append(ids[i])
        known, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, self.lists)]), return_counts=True)
        #: Shingles of few items weigh more; in thousandths, so that sums are exact.
        self.known, self.weight = known, np.round(1000 * (1 + np.log(len(self.ids) / np.maximum(df, 1)))).astype(np.int64)
        self.unknown = int(round(1000 * (1 + np.log(max(len(self.ids), 1)))))
        owners = [[] for _ in known]
        for item, found in enumerate(self.lists):
            for at in np.searchsorted(known, np.unique(found)).tolist():
                owners[at].append(item)
        self.owners = owners
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.array([self.fingerprints(s, np.zeros(1, np.int64), len(s))[0] for s in self.lists], np.uint64)
        self.index: list[dict[int, list[int]]] = [{} for _ in range(BLOCKS)]
        for item, value in enumerate(self.prints.tolist()):
            for block, part in enumerate(_parts(value)):
                for near in _nearby(part, block):
                    self.index[block].setdefault(near, []).append(item)

    def weights(self, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, found), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == found, self.weight[at], self.unknown) if len(self.known) else np.full(len(found), self.unknown)

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Positions of shingles that an item has."""
        at = np.flatnonzero(self.maybe[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.known, found[at]), max(len(self.known) - 1, 0))
        return at[self.known[near] == found[at]] if len(self.known) else at[:0]

    def fingerprints(self, found: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """SimHash of found[s : s + length] for every s in starts."""
        bits = np.unpackbits(mix64(found).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        sums = np.zeros((len(found) + 1, 64), np.int64)
        np.cumsum((2 * bits - 1) * self.weights(found)[:, None], axis=0, out=sums[1:])
        over = sums[starts + length] - sums[starts] > 0
        return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()

    def within_radius(self, value: int, size: int) -> list[int]:
        """Items of that size whose fingerprint is RADIUS away at most: all of them."""
        near = {i for block, part in enumerate(_parts(value)) for i in self.index[block].get(part, ())}
        return [i for i in near if self.size[i] == size and (value ^ int(self.prints[i])).bit_count() <= RADIUS]

    def similarity(self, found: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        a, b = Counter(found.tolist()), Counter(self.lists[item].tolist())
        every = list(a | b)
        weight = dict(zip(every, self.weights(np.array(every, np.uint64)).tolist(), strict=True))
        return sum(weight[s] * n for s, n in (a & b).items()) / sum(weight[s] * n for s, n in (a | b).items())

    def leaks(self, found: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, end word) of each item in the shingles of one text: its best window, the first of equals.

        For items longer than the text, the whole text is the window.
        """
        at = self.hits(found)
        near: dict[int, list[int]] = {}
        for p, s in zip(at.tolist(), np.searchsorted(self.known, found[at]).tolist(), strict=True):
            for item in self.owners[s]:
                near.setdefault(self.size[item], []).append(p)
        best: dict[int, tuple[float, int]] = {}
        whole = None
        for size, positions in near.items():
            length = size - self.k + 1
            if len(found) < length:
                if whole is None:
                    whole = int(self.fingerprints(found, np.zeros(1, np.int64), len(found))[0])
                for item in self.within_radius(whole, size):
                    if (score := self.similarity(found, item)) >= least:
                        best[item] = (score, 0)
                continue
            p = np.unique(positions)
            starts = np.unique(np.clip((p[:, None] - np.arange(length)).ravel(), 0, len(found) - length))
            for part in np.split(starts, np.flatnonzero(np.diff(starts // _SPAN)) + 1):
                low = int(part[0])
                prints = self.fingerprints(found[low : int(part[-1]) + length], part - low, length)
                for start, value in zip(part.tolist(), prints.tolist(), strict=True):
                    for item in self.within_radius(value, size):
                        score = self.similarity(found[start : start + length], item)
                        if score >= least and score > best.get(item, (0.0, 0))[0]:
                            best[item] = (score, start)
        end = len(found) + self.k - 1
        return [(self.ids[i], s, start, min(start + self.size[i], end)) for i, (s, start) in sorted(best.items())]

    def of_batch(self, column: pa.Array, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """leaks() of every text of a column, each after its row."""
        for row, _, data, offsets in text_chunks(column):
            _, _, hashes, first = words(data, offsets)
            every = shingles(hashes, self.k)
            touched = np.unique(np.searchsorted(first, self.hits(every), "right") - 1)
            for i in touched.tolist():
                a, b = int(first[i]), int(first[i + 1])
                if b - a >= self.k:
                    yield from ((row + i, *leak) for leak in self.leaks(every[a : b - self.k + 1], least))
            n = np.diff(first)
            for i in np.flatnonzero((n > 0) & (n < self.k)).tolist() if self.short else ():
                a, b = int(first[i]), int(first[i + 1])
                yield from ((row + i, item, 1.0, 0, b - a) for item in self.short.get(tuple(hashes[a:b].tolist()), ()))


def _parts(value: int) -> list[int]:
    return [value >> int(a) & (1 << int(b - a)) - 1 for a, b in zip(_BIT_ENDS, _BIT_ENDS[1:], strict=False)]


def _nearby(part: int, block: int) -> list[int]:
    """All values of a block that differ from part in RADIUS // BLOCKS bits at most."""
    width = range(int(_BIT_ENDS[block + 1] - _BIT_ENDS[block]))
    return [part ^ sum(1 << b for b in flip) for n in range(RADIUS // BLOCKS + 1) for flip in combinations(width, n)]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, k: int, broadcast_words: int = BROADCAST_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of about broadcast_words words; null texts are empty. Repeated items count each."""
    rows = only(benchmark, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    n = max(1, -(-total // broadcast_words))
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        yield Items(got.column("id").to_pylist(), got.column("text").combine_chunks().cast(pa.large_string()), k)


def leaks(
    docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """A row for each item that a row of docs holds: doc_id, item_id, similarity, start_word, end_word.

    Words are compared with A-Z in lower case. The window is the best one, the first of equals; for
    items longer than the text it is the whole text. Null and empty texts hold nothing. An item of
    fewer than k words is held by the texts of exactly its words, with similarity 1. Rows that
    repeat an id are searched each. Empty input gives no rows; other columns are ignored.
    """
    narrow = only(docs, id_col, text_col)
    item_type = only(benchmark, item_col).schema[0].dataType
    fields = [("doc_id", narrow.schema[0].dataType), ("item_id", item_type), ("similarity", T.DoubleType()), ("start_word", T.LongType()), ("end_word", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def search(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [to_arrow_type(f.dataType) for f in schema][1:]
            for batch in batches:
                found = list(items.of_batch(batch.column(1), least))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[i] for f in found], t) for i, t in enumerate(kinds, 1))], names=schema.names)

        return run

    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, k, broadcast_words):
        one = narrow.mapInArrow(search(items), schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all their columns; see leaks().

    Null and empty texts stay, as do all rows if the benchmark is empty; repeated rows stay or go
    alike. One block of items filters the rows as they are read. With more, hashes of the texts that
    hold an item are found block by block, and rows with such a text go.
    """
    if text_col not in docs.columns:
        return docs
    blocks = item_blocks(benchmark, "item_id", "text", k, broadcast_words)
    first, second = next(blocks), next(blocks, None)
    names = docs.columns

    def keep(items: Items):
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in items.of_batch(batch.column(at), least)]] = False
                yield batch.filter(pa.array(clean))

        return run

    if second is None:
        return docs.mapInArrow(keep(first), T.StructType(docs.schema.fields))
    key = fresh(docs, "__text_key")
    marked = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    hashed = only(docs, text_col).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def holding(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = sorted({f[0] for f in items.of_batch(batch.column(1), least)})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))], names=["key"])

        return run

    found = [materialize(hashed.mapInArrow(holding(items), "key bigint")) for items in (first, second)]
    found += [materialize(hashed.mapInArrow(holding(items), "key bigint")) for items in blocks]
    leaking = materialize(reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("key", key))
    return marked.join(small(leaking), key, "left_anti").select(*(F.col(f"`{c}`") for c in names))

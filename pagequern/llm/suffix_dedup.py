"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document that
comes before, or earlier in its own.

1. Every window of ``length`` bytes has an anchor, the smallest hash of its substrings of GRAM
   bytes, the leftmost of equals. Equal windows have equal anchors at equal places, so windows of
   an anchor whose hash no other anchor has occur once. Only suffixes at the other anchors count.
2. Tasks sort their suffixes, each with the text before its anchor. Suffixes alike in both settle
   at once: the earliest stays, all windows of the others go. The rest leaves front-coded, by anchor.
3. A loser tree merges the sorted runs of a bucket and yields common prefixes with the order. Two
   windows that start o bytes before their anchors are equal if their suffixes share length - o
   bytes and what lies before the anchors shares o. Both are intervals of a sorted order, cut
   where the common prefix is shorter, so equal windows are found for each o by two interval
   numbers and all but the earliest go. No pair is compared.
   An anchor of a passage that very many texts share would bring all of them to one bucket. Hot
   anchors are found in a sample, and each of their suffixes goes to a bucket for each of a few
   spans of o instead, named by the bytes on either side that all windows of that span hold. Most
   of them are then alike and settle in step 2, the others part by what is before the anchor.
4. Ranges are merged for each document and cut from its text.

Equal texts are settled by their hash first, and only one of them takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequern.llm._graph import lookup
from pagequern.llm._shared import discard, materialize, only, small
from pagequern.llm._suffix_runs import Run, common_prefix, merge, pack, unpack
from pagequern.llm._text import byte_sums, range_hash, text_chunks

LENGTH, GRAM = 100, 32
#: Bytes of a text in which anchors are sought at once.
SEGMENT = 1 << 21
#: Suffixes of a sorted run, and of a bucket, about.
RUN, BUCKET = 1 << 17, 1 << 16
#: Tables of up to so many places, or spans (16 bytes each), are broadcast to the texts that they are about; larger ones are joined by shuffle.
BROADCAST_PLACES, BROADCAST_SPANS = 1 << 17, 1 << 20
#: Spans of distances from a window's start to its anchor, by their ends, into which hot anchors are split.
SPANS = (1, 2, 3, 5, 8, 12, 18, 28, 45, 256)
#: One text in so many is looked at for hot anchors: at least so many of them, and more than a share of all, have the same hash.
SAMPLE, HOT_LEAST, HOT_SHARE = 64, 8, 1e-4
#: Texts that occur several times, 100 bytes each, that are broadcast to find the row that stands for them; more are joined by shuffling the anchors.
COPIED = 1 << 18
_LAST = (1 << 63) - 1


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each anchor of one text. place packs the first window's start, how many windows, and the anchor's distance from that start."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        n = len(part) - gram + 1
        at = np.arange(n)
        h = range_hash(byte_sums(part), at, at + gram)
        position = np.uint64((1 << 23) - 1)
        least = (h & ~position) | at.astype(np.uint64)
        size, width = 1, length - gram + 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        anchor = (least & position).astype(np.int64)
        start = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(start, append=len(anchor))
        hashes.append(h[anchor[start]])
        places.append((start + low) << 16 | count << 8 | (anchor[start] - start))
    return np.concatenate(hashes), np.concatenate(places)


_ANCHORS = "id bigint, text_key bigint, n_bytes bigint, sha string, hashes array<bigint>, places array<bigint>"


def _anchor_rows(length: int):
    """(id, text_key, text) to _ANCHORS; a task gives the anchors of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column("text")):
                sha, found = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    sha.append(hashlib.sha256(data[a:b]).hexdigest())
                    found.append(anchors(data[a:b] if sha[-1] not in seen else data[:0], length))
                    seen.add(sha[-1])
                    if len(seen) > 1 << 18:
                        seen.clear()
                ends = pa.array(np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32))
                lists = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, end - row) for c in ("id", "text_key")), pa.array(np.diff(offsets)), pa.array(sha), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)],
                    names=["id", "text_key", "n_bytes", "sha", "hashes", "places"],
                )

    return run


def sorted_run(right: list[bytes], left: list[bytes], about: np.ndarray, gram_hash: np.ndarray) -> Iterator[tuple[int, Run]]:
    """The suffixes in order by bucket number; those alike in both directions are settled but for the earliest.

    about has columns doc, row, place (the anchor's), low: the run's windows start low to len(left)
    bytes before the anchor. gram_hash: the bucket of each.
    """
    low = about[:, 3].tolist()
    where = [(b, d, r, p) for b, d, r, p in zip(gram_hash.tolist(), *about[:, :3].T.tolist(), strict=True)]
    order = sorted(range(len(right)), key=lambda i: (where[i][0], right[i], left[i], low[i], where[i][1:]))
    run, keep, settled, now, last = Run(), [], [], None, -1

    def done() -> Run:
        run.about = about[keep].reshape(-1, 4)
        run.settled = np.array(settled, np.int64).reshape(-1, 3)
        return run

    for i in order:
        if where[i][0] != now:
            if keep:
                yield now, done()
            run, keep, settled, now, last = Run(), [], [], where[i][0], -1
        if last >= 0 and right[i] == right[last] and left[i] == left[last] and low[i] == low[last]:
            place = where[i][3]
            if where[i] == where[last]:  # the same suffix again, of a row that repeats id and text
                continue
            settled.append((where[i][2], place - len(left[i]), place + len(right[i])))
            continue
        run.lcp.append(common_prefix(right[last], right[i]) if last >= 0 else 0)
        run.right.append(right[i])
        run.left.append(left[i])
        keep.append(i)
        last = i
    if keep:
        yield now, done()


def split_suffix(right: bytes, left: bytes, low: int, name: int, length: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(right, left, low, name) of a hot anchor's suffix for each of SPANS: equal windows have equal names."""
    begin = 0
    for end in SPANS:
        first, last = max(low, begin), min(len(left), end - 1)
        if first <= last:
            own = right[: length - first], left[:last]
            common = right[: max(length - end + 1, 0)], left[:begin]
            key = hashlib.blake2b(b"%d %d %d " % (name, begin, len(common[0])) + b"".join(common), digest_size=8).digest()
            yield *own, first, int.from_bytes(key, "little")
        begin = end


def _run_rows(length: int, buckets: int):
    """(text, flagged anchors, doc, row) to (bucket, run): front-coded sorted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, left, about, names = [], [], [], []

        def flush():
            found = list(sorted_run(right, left, np.array(about, np.int64).reshape(-1, 4), np.array(names, np.uint64) % np.uint64(buckets)))
            right.clear(), left.clear(), about.clear(), names.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([pack(r) for _, r in found], pa.binary())], names=["bucket", "run"])

        for batch in batches:
            texts, docs, rows, lists = (batch.column(c) for c in ("text", "doc", "row", "flagged"))
            for i in range(batch.num_rows):
                data, doc, row = (texts[i].as_py() or "").encode(), docs[i].as_py(), rows[i].as_py()
                for name, packed, hot in zip(*(lists[i].values.field(f).to_pylist() for f in ("hash", "place", "hot")), strict=True):
                    start, count, off = packed >> 16, packed >> 8 & 255, packed & 255
                    one = data[start + off : start + count - 1 + length], data[start : start + off][::-1], off - count + 1, name & (1 << 64) - 1
                    for r, l, low, n in split_suffix(*one, length) if hot else (one,):
                        right.append(r)
                        left.append(l)
                        about.append((doc, row, start + off, low))
                        names.append(n)
                    if len(right) >= RUN:
                        yield flush()
        if right:
            yield flush()

    return run


def repeated_windows(runs: list[Run], length: int = LENGTH) -> np.ndarray:
    """Rows (row, start, end) of bytes that the merged runs show to be repeated, settled ones included."""
    order = list(merge([(r.right, r.lcp) for r in runs]))
    first = np.cumsum([0, *(len(r.right) for r in runs)])[:-1].tolist()
    n = len(order)
    settled = np.concatenate([np.zeros((0, 3), np.int64), *(r.settled for r in runs)])
    if not n:
        return settled
    at = np.array([first[r] + i for r, i, _ in order])
    about = np.concatenate([r.about for r in runs])[at]
    left = [x for r in runs for x in r.left]
    left = [left[i] for i in at.tolist()]
    right_lcp = np.array([x for _, _, x in order])
    by_left = sorted(range(n), key=left.__getitem__)
    left_lcp = np.array([0, *(common_prefix(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False))])
    by_left, high, low = np.array(by_left), np.array([*map(len, left)]), about[:, 3]
    earliest = np.lexsort((about[:, 3], about[:, 2], about[:, 1], about[:, 0]))
    again = np.zeros(n, bool)  # the same windows of a suffix from another run, of a row that repeats id and text
    again[earliest[1:]] = (about[earliest[1:]] == about[earliest[:-1]]).all(axis=1)
    earliest = earliest[~again[earliest]]
    left_number, out = np.zeros(n, np.int64), []
    for o in range(length - 1, -1, -1):
        own = (low <= o) & (o <= high) & ~again
        if np.count_nonzero(own) < 2:
            continue
        left_number[by_left] = np.cumsum(left_lcp < o)
        key = np.cumsum(right_lcp < length - o) * (n + 1) + left_number
        some = earliest[own[earliest]]
        _, kept = np.unique(key[some], return_index=True)
        gone = np.ones(len(some), bool)
        gone[kept] = False
        start = about[some[gone], 2] - o
        out.append(np.stack([about[some[gone], 1], start, start + length], axis=1))
    return joined_ranges(np.concatenate([settled, *out]))


def joined_ranges(ranges: np.ndarray) -> np.ndarray:
    """Maximal ranges of each row: those that overlap or touch become one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    row, start, end = ranges.T
    group = np.cumsum(np.diff(row, prepend=row[0]) != 0)
    reach = end + group * (1 << 40)  # so that a row's ends don't reach into the next row
    before = np.maximum.accumulate(reach)[:-1]
    new = np.ones(len(ranges), bool)
    new[1:] = (start + group * (1 << 40))[1:] > before
    at = np.flatnonzero(new)
    return np.stack([row[at], start[at], np.maximum.reduceat(end, at)], axis=1)


def _range_rows(length: int):
    """(bucket, run), sorted by bucket, to (row, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def done():
            found = repeated_windows(runs, length)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], names=["row", "start", "end"])

        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if bucket != now and runs:
                    yield done()
                    runs = []
                now = bucket
                runs.append(unpack(packed))
        if runs:
            yield done()

    return run


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, row, spans) to (row, n_removed, kept_sha256)."""
    for batch in batches:
        rows, spans = batch.column("row"), batch.column("spans")
        removed, sha = [], []
        for i in range(batch.num_rows):
            data, at, total, digest = (batch.column("text")[i].as_py() or "").encode(), 0, 0, hashlib.sha256()
            for start, end in zip(*(spans[i].values.field(f).to_pylist() for f in ("start", "end")), strict=True):
                digest.update(data[at:start])
                at, total = end, total + end - start
            digest.update(data[at:])
            removed.append(total)
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([rows, pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["row", "n_removed", "kept_sha256"])


def _with_texts(rows: DataFrame, about: DataFrame, few: bool, columns: list[str]) -> DataFrame:
    """about, which names texts by id and text_key, with the texts themselves; a repeated text comes once for each row."""
    about = about.withColumnsRenamed({"id": "__id", "text_key": "__key"})
    about = F.broadcast(about) if few else about
    return rows.join(about, rows["id"].eqNullSafe(about["__id"]) & (rows["text_key"] == about["__key"])).select("text", *columns)


def _hot_hashes(some: DataFrame) -> list[int]:
    """Hashes of the sampled anchors that very many texts seem to have, 1 / HOT_SHARE at most: they are in several of the sample, so they are shared for sure."""
    counts = materialize(some.groupBy("hash").agg(F.count("*").alias("many")).where(F.col("many") >= HOT_LEAST))
    total = some.count() if not counts.isEmpty() else 0
    return sorted(r.hash for r in counts.where(F.col("many") > F.lit(HOT_SHARE * total)).collect())


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run).

    Texts are UTF-8 bytes, null is empty, and matches never cross texts. Ids are integers; a null id
    comes after all others, and rows that repeat an id come in the order in which they are read. Of
    equal texts the first is judged as any other; the others go whole, unless they are shorter than
    length. Texts shorter than length keep all bytes. Empty input gives no rows; other columns are ignored.
    """
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    anchored = materialize(rows.mapInArrow(_anchor_rows(length), _ANCHORS).withColumn("row", F.monotonically_increasing_id()))
    table = materialize(anchored.withColumn("keyed", F.size("places") > 0).drop("hashes", "places"))

    # Of equal texts the first stands for all; the anchors are with any of them, v.
    doc = F.coalesce("id", F.lit(_LAST))
    classes = table.groupBy("sha").agg(
        F.count("*").alias("copies"), F.min(F.when(F.col("keyed"), F.struct("row", "id"))).alias("keyed"),
        F.min(F.struct(doc.alias("doc"), "row")).alias("best"), F.first("text_key").alias("text_key"), F.first("n_bytes").alias("n_bytes"),
    )
    classes = materialize(classes.select("sha", "copies", "best", "text_key", "n_bytes", F.col("keyed.row").alias("v"), F.col("keyed.id").alias("id")))
    again = small(classes.where("copies > 1 AND v IS NOT NULL").select(F.col("sha").alias("c"), "v"), COPIED)
    once = anchored.where(F.size("places") > 0).join(again, F.col("sha") == F.col("c"), "left").where("v IS NULL OR v = row")
    def exploded(rows: DataFrame) -> DataFrame:
        return rows.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("row", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))

    found, hot = exploded(once), _hot_hashes(exploded(once.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)))
    is_hot = F.col("hash").isin(hot)
    same = Window.partitionBy("hash").orderBy("row", "place")
    rest = found.where(~is_hot) if hot else found
    shared = rest.select("row", "hash", "place", F.lag("row").over(same).alias("one"), F.lead("row").over(same).alias("other"))
    shared = shared.where("one IS NOT NULL OR other IS NOT NULL").select("row", "hash", "place", F.lit(False).alias("hot"))
    shared = shared.unionByName(found.where(is_hot).withColumn("hot", F.lit(True))) if hot else shared
    flagged = shared.groupBy("row").agg(F.collect_list(F.struct("hash", "place", "hot")).alias("flagged"))
    named = classes.where("v IS NOT NULL").select(F.col("v").alias("row"), "id", "text_key", F.col("best.doc").alias("doc"))
    flagged = materialize(flagged.join(named, "row"))
    discard(anchored)
    places = flagged.agg(F.coalesce(F.sum(F.size("flagged")), F.lit(0))).first()[0]

    texts = _with_texts(rows, flagged, places <= BROADCAST_PLACES, ["doc", "row", "flagged"])
    runs = texts.mapInArrow(_run_rows(length, max(1, -(-places // BUCKET))), "bucket bigint, run binary")
    ranges = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_range_rows(length), "row bigint, start bigint, end bigint")
    in_row = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("span", F.sum("new").over(in_row))
    spans = ranges.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = materialize(spans.join(named, "row").select("row", "id", "text_key", "spans"))
    n_spans = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    cut = _with_texts(rows, spans, n_spans <= BROADCAST_SPANS, ["row", "spans"]).mapInArrow(_cut_rows, "row bigint, n_removed bigint, kept_sha256 string")
    cut = cut.dropDuplicates(["row"]).join(spans.select("row", "spans"), "row").withColumnRenamed("row", "v")

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    of_class = classes.join(cut, "v", "left").select(
        "sha", "copies", F.col("best.row").alias("best_row"), F.coalesce("n_removed", F.lit(0)).alias("first_removed"),
        F.coalesce("kept_sha256", "sha").alias("first_kept"), F.coalesce("spans", none).alias("first_spans"),
    )
    every = lookup(table.select("id", "row", "n_bytes", "sha"), materialize(of_class), "sha", "copies")
    goes = (F.col("row") != F.col("best_row")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(goes, whole).otherwise(F.col("first_spans"))
    return every.select(
        F.col("id").alias("doc_id"), "n_bytes", F.when(goes, F.col("n_bytes")).otherwise(F.col("first_removed")).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), F.when(goes, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("first_kept")).alias("kept_sha256"),
        spans.alias("spans"),
    )

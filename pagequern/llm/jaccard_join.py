"""N-gram Jaccard self-join over size-banded tiles with hashed bitmap signatures.

1. A document becomes the sorted set of its k-word shingle hashes. Equal sets are one class from
   then on, so copies never meet each other again.
2. Candidates. In a size band two linked sets differ in D shingles at most. Hash space is cut into
   more ranges than D, so linked sets agree on a whole range; each range's content is hashed to a
   key. A range with one shingle or none gives no key, as any passage that texts share would match
   there: Z spare ranges make up for that, and the rare sets with more than Z such ranges also give
   keys for their prefix, the smallest hashes, of which linked sets must share one. Of up to GROUP
   sets that share a key, pairs are tested by parity bitmaps: a bit is whether an odd number of
   shingles hash to it, so two sets differ in as many shingles as bits at least. Groups of up to
   CROWD are compared in one place, and only sets that are not yet connected. Larger ones, whose
   keys are found in a sample and counted with partial sums, hang on one of their sets without a
   test, so that no task holds a group. What is left connected is a cluster.
3. A cluster sorted by set size is cut into blocks of bounded size, and two blocks make a tile. For
   clusters of many blocks the first round has tiles of neighbours only: copies of one text are
   one component after it. The second round compares the sets outside of a cluster's largest
   component with each other and with that component, where sizes can link at all. Pairs within
   the component can't add anything.
4. In a tile, sets carry hashed bitmaps. Differing bits bound the overlap from above; only pairs
   that pass, and are not yet connected in the tile, intersect their sorted arrays. A tile returns
   a forest of its links, and the components of all forests are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequern.llm._graph import components, lookup
from pagequern.llm._shared import discard, fresh, materialize, only, small
from pagequern.llm._text import mix64, shingle_sets, text_chunks

#: Shingles of a block; a tile holds two blocks.
BLOCK_SHINGLES = 1 << 21
#: A list of candidates of up to so many rows (24 bytes each) is broadcast to pick their texts; a longer one is joined by shuffle.
BROADCAST_ROWS = 1 << 20
#: Classes of several rows, 24 bytes each, that are broadcast to find the row that stands for them; more are joined by shuffling the sets with their keys.
COPIED = 1 << 18
#: Sets with a common key that are paired as rows; more are compared where they meet, up to CROWD.
GROUP, CROWD = 16, 1 << 12
#: One set in so many is looked at for keys that more than CROWD sets have, and that are in more than a share of the sampled keys.
SAMPLE, HOT_SHARE = 64, 1e-5
#: Keys have 48 bits, the upper ones: enough to keep chance apart, as candidates are tested, and the rest compresses to nothing.
_KEY_BITS = np.uint64((1 << 64) - (1 << 16))
#: Lower ends of size bands grow by this factor.
_GROWTH = 1.3
#: Bits of all bitmaps of a tile together, about.
_MAP_BITS = 1 << 29
#: A set counts as so many shingles at least, which bounds the sets of a block.
_LEAST_SET = 256


class Bands:
    """Which tiles of the size scale a set belongs to, and into how many ranges each cuts the hash space."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]
        self._edges: dict[int, np.ndarray] = {}

    def of(self, n: int) -> list[int]:
        """The bands of the smaller sets that can link to one of n: n's own, and those below down to percent of n."""
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * _GROWTH)))
        band = int(np.searchsorted(self.lows, n, "right")) - 1
        lowest = int(np.searchsorted(self.lows, max(-(-n * self.percent // 100), 1), "right")) - 1
        return list(range(max(lowest, 0), band + 1))

    def differ(self, band: int) -> int:
        """The most shingles that two linked sets, the smaller one of this band, don't share."""
        small = self.lows[band + 1] - 1
        return (small + small * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def spare(self, band: int) -> int:
        return 3 + ceil(0.15 * self.differ(band))

    def edges(self, band: int) -> np.ndarray:
        """Lower ends of the ranges of hash space."""
        if band not in self._edges:
            m = self.differ(band) + 1 + self.spare(band)
            self._edges[band] = np.array([(i << 64) // m for i in range(m)], np.uint64)
        return self._edges[band]

    def keys(self, band: int, found: np.ndarray) -> np.ndarray:
        """The keys of a sorted set; sets that are linked in this band share one."""
        if not self.differ(band):  # then only equal sets are linked
            return np.zeros(0, np.uint64)
        at = np.searchsorted(found, self.edges(band))
        count = np.diff(at, append=len(found))
        full = np.flatnonzero(count > 1)
        name = mix64(np.uint64(band << 32) + full.astype(np.uint64))
        sums = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(mix64(found + np.uint64(1)), out=sums[1:])
        keys = mix64((sums[at[full] + count[full]] - sums[at[full]]) ^ name)
        if len(at) - len(full) > self.spare(band):
            prefix = found[: len(found) - -(-len(found) * self.percent // 100) + 1]
            keys = np.concatenate([keys, mix64(prefix ^ mix64(np.full(1, (band << 1) + 1, np.uint64)))])
        return keys & _KEY_BITS


def _class_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def parity_map(found: np.ndarray) -> bytes:
    """Of a power of two bits, as many as shingles or up to twice as many: whether an odd number of shingles hash to it."""
    bits = 1 << max(6, (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, one: bytes, m: int, other: bytes, percent: int) -> bool:
    """Whether two sets of n and m shingles can be linked as far as their parity maps tell."""
    if min(n, m) * 100 < percent * max(n, m):
        return False
    if len(one) < len(other):
        one, other = other, one
    a, b, bits = int.from_bytes(one, "little"), int.from_bytes(other, "little"), 4 * len(one)
    while bits >= 8 * len(other):  # the larger map folds to what a smaller one would be
        a, bits = (a >> bits) ^ (a & ((1 << bits) - 1)), bits // 2
    return (a ^ b).bit_count() * (100 + percent) <= (n + m) * (100 - percent)


def _tested(percent: int):
    """Edges (a, b, n1, map1, n2, map2) to those that may_link() leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = (batch.column(c).to_pylist() for c in ("n1", "map1", "n2", "map2"))
            keep = pa.array([may_link(*x, percent) for x in zip(*rest, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def crowd_forest(ids: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that connect whatever pairs of sets, sorted by size, may_link() connects."""
    width = min(map(len, maps))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, width // 8), axis=0) for m in maps])
    group, edges = np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        rest = np.flatnonzero(group[i + 1 : end] != group[i]) + i + 1
        apart = np.bitwise_count(folded[rest] ^ folded[i]).sum(axis=1, dtype=np.int64)
        for j in rest[apart * (100 + percent) <= (sizes[rest] + sizes[i]) * (100 - percent)].tolist():
            if group[i] != group[j]:
                edges.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return edges


def _crowd_edges(percent: int):
    """(key, row, n, map), sorted by key and n, to edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done():
            ids, sizes, maps = zip(*rows, strict=True)
            found = crowd_forest(np.array(ids), np.array(sizes), maps, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "n", "map")), strict=True):
                if key != now and rows:
                    yield done()
                    rows = []
                now = key
                rows.append(row)
        if rows:
            yield done()

    return run


_SETS = "id {id}, text_key bigint, n bigint, class binary, keys array<bigint>, map binary"


def _sets(k: int, percent: int):
    """(id, text, text_key) to _SETS; a task gives keys and map of a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column("text")):
                n, names, keys, maps = [], [], [], []
                for found in shingle_sets(data, offsets, k):
                    n.append(len(found))
                    names.append(name := _class_key(found))
                    new = name not in seen
                    seen.add(name)
                    keys.append(np.concatenate([bands.keys(b, found) for b in bands.of(len(found))]) if new and len(found) else np.zeros(0, np.uint64))
                    maps.append(parity_map(found) if len(keys[-1]) else b"")
                    if len(seen) > 1 << 20:  # copies that come later only repeat their keys
                        seen.clear()
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                values = pa.array(signed(np.concatenate(keys)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, end - row) for c in ("id", "text_key")), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(maps, pa.binary())],
                    names=["id", "text_key", "n", "class", "keys", "map"],
                )

    return run


def _members(k: int):
    """(text, class, v, tiles) to (tile, v, n, shingles), a row for each tile; texts of another class fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in text_chunks(batch.column("text")):
                for i, found in enumerate(shingle_sets(data, offsets, k), row):
                    if _class_key(found) == batch.column("class")[i].as_py():
                        tiles = batch.column("tiles")[i].as_py()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(tiles, pa.int64()), pa.array([batch.column("v")[i].as_py()] * len(tiles), pa.int64()), pa.array([len(found)] * len(tiles), pa.int64()), pa.array([found.tobytes()] * len(tiles), pa.binary())],
                            names=["tile", "v", "n", "shingles"],
                        )

    return run


def tile_forest(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets, sorted by size, that connect whatever the tile's links connect."""
    bits = 1 << int(4 * max(map(len, sets))).bit_length()
    bits = max(64, min(bits, 1 << (_MAP_BITS // len(sets)).bit_length() - 1))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for i, found in enumerate(sets):
        at = found & np.uint64(bits - 1)
        np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    sizes, group, links = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        rest = np.flatnonzero(group[i + 1 : end] != group[i]) + i + 1
        if not len(rest):
            continue
        apart = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        both = sizes[rest] + sizes[i]
        most = (both - apart) // 2
        for j in rest[100 * most >= percent * (both - most)].tolist():
            if group[i] != group[j]:
                shared = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * shared >= percent * (int(sizes[i] + sizes[j]) - shared):
                    links.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]
    return links


def _links(percent: int):
    """(tile, v, n, shingles), a partition sorted by tile and n, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def done():
            found = tile_forest(ids, sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for tile, v, found in zip(*(batch.column(c).to_pylist() for c in ("tile", "v", "shingles")), strict=True):
                if tile != now and ids:
                    yield done()
                    ids, sets = [], []
                now = tile
                if not ids or ids[-1] != v:  # a class comes once for each row that repeats its id and text
                    ids.append(v)
                    sets.append(np.frombuffer(found, np.uint64))
        if ids:
            yield done()

    return run


def _placed(members: DataFrame, group: list[str], block_shingles: int) -> DataFrame:
    """members (group, v, n) with the block that each is in: by size within its group, by hash among equal sizes.

    Only sums by size are sorted in one place for a group, never its members.
    """
    of_size = members.groupBy(*group, "n").agg(F.sum(F.greatest("n", F.lit(_LEAST_SET))).alias("w"), F.count("*").alias("many"))
    before = Window.partitionBy(*group).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.withColumn("start", F.coalesce(F.sum("w").over(before), F.lit(0)))
    of_size = materialize(of_size.select(F.struct(*group, "n").alias("at"), "start", "w", "many"))
    found = lookup(members.withColumn("at", F.struct(*group, "n")), of_size, "at", "many")
    within = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) / F.lit(1 << 20) * F.col("w")
    return found.withColumn("block", F.floor((F.col("start") + within) / block_shingles).cast("long")).drop("at", "start", "w")


def _tiles(clustered: DataFrame, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(v, tiles) of the first round, and the members (v, root, n) of clusters that need a second one."""
    weight = F.greatest("n", F.lit(_LEAST_SET))
    of_root = materialize(clustered.groupBy("root").agg(F.sum(weight).alias("w"), F.count("*").alias("many")))
    found = lookup(clustered.select("v", "root", "n"), of_root, "root", "many")
    one = found.where(F.col("w") <= 2 * block_shingles).select("v", F.array(F.xxhash64("root")).alias("tiles"))
    large = found.where(F.col("w") > 2 * block_shingles).drop("w")
    if large.isEmpty():
        return one, large
    large = materialize(_placed(large, ["root"], block_shingles))
    beside = F.array(F.xxhash64("root", "block"), F.xxhash64("root", F.col("block") - 1))
    return one.unionByName(large.select("v", beside.alias("tiles"))), large.drop("block")


def _late_tiles(large: DataFrame, labels: DataFrame, block_shingles: int, percent: int) -> DataFrame:
    """(v, tiles) of the second round: what is outside of its cluster's largest component against all of the cluster."""
    comp = materialize(large.join(labels.withColumnRenamed("root", "comp"), "v", "left").withColumn("comp", F.coalesce("comp", "v")))
    sizes = comp.groupBy("root", "comp").agg(F.count("*").alias("many"))
    main = sizes.groupBy("root").agg(F.max(F.struct("many", "comp")).alias("main"), F.sum("many").alias("all"))
    main = materialize(main.select("root", F.col("main.comp").alias("main"), F.col("main.many").alias("in_main"), "all"))
    open_ = lookup(comp, main.where("in_main < all").drop("in_main"), "root", "all").withColumn("inner", F.col("comp") == F.col("main")).drop("comp", "main")
    placed = materialize(_placed(open_, ["root", "inner"], block_shingles))
    blocks = placed.groupBy("root", "inner", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (blocks.select("root", *(F.col(c).alias(f"{c}{i}") for c in ("inner", "block", "low", "high"))) for i in (1, 2))
    pairs = left.where("NOT inner1").join(right, "root").where(F.col("inner2") | (F.col("block1") <= F.col("block2")))
    pairs = pairs.where((F.col("low2") * percent <= F.col("high1") * 100) & (F.col("low1") * percent <= F.col("high2") * 100))
    pairs = pairs.withColumn("tile", F.xxhash64("root", "block1", "inner2", "block2"))
    sides = pairs.select("root", "tile", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"inner{i}").alias("inner"), F.col(f"block{i}").alias("block")) for i in (1, 2))))).alias("side"))
    sides = sides.groupBy("root", "side").agg(F.collect_set("tile").alias("tiles")).select(F.struct("root", "side.inner", "side.block").alias("at"), "tiles")
    sizes = placed.groupBy("root", "inner", "block").agg(F.count("*").alias("many")).select(F.struct("root", "inner", "block").alias("at"), "many")
    return lookup(placed.withColumn("at", F.struct("root", "inner", "block")), materialize(sides.join(sizes, "at")), "at", "many").select("v", "tiles")


def _tile_links(rows: DataFrame, clustered: DataFrame, tiles: DataFrame, k: int, percent: int, broadcast_rows: int) -> DataFrame:
    """The links (a, b) that tile_forest() finds in all tiles; rows (id, text) are read once for it."""
    members = materialize(clustered.join(tiles, "v").select(F.col("id").alias("rep"), "v", "class", "tiles"))
    few = members.count() <= broadcast_rows
    texts = rows.join(F.broadcast(members) if few else members, rows["id"].eqNullSafe(members["rep"])).select("text", "class", "v", "tiles")
    sets = texts.mapInArrow(_members(k), "tile bigint, v bigint, n bigint, shingles binary")
    sets = sets.repartition("tile").sortWithinPartitions("tile", "n", "v")
    return sets.mapInArrow(_links(percent), "a bigint, b bigint")


def _hot_keys(with_keys: DataFrame) -> DataFrame:
    """Keys that more than CROWD sets seem to have, by a sample of sets; a broadcast of 1 / HOT_SHARE keys at most."""
    some = with_keys.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    counts = materialize(some.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > CROWD / (2 * SAMPLE)))
    total = some.count() if not counts.isEmpty() else 0
    return counts.where(F.col("many") > F.lit(HOT_SHARE * total)).select("key")


def cluster(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
    block_shingles: int = BLOCK_SHINGLES, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, text_key, kept.

    Words are runs of non-space characters with A-Z in lower case. Two rows link if the Jaccard
    similarity of their shingle sets is percent / 100 or more, equal sets included; component_id is
    the smallest id that links lead to. A text without words, or null, has an empty set and is
    linked with nothing. kept marks one row of each component, of its smallest id (a null id is
    larger than any other). text_key is xxhash64 of the text. Rows that repeat an id are documents
    of their own. Empty input gives no rows; other columns are ignored.
    """
    id_type = dict(docs.dtypes).get(id_col, "string")
    rows = only(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    with_keys = materialize(rows.mapInArrow(_sets(k, percent), _SETS.format(id=id_type)).withColumn("row", F.monotonically_increasing_id()))
    found = materialize(with_keys.withColumn("keyed", F.size("keys") > 0).drop("keys", "map"))

    # Of a class, the first row that has keys stands for all.
    no_id = F.col("id").isNull()
    classes = found.where("n > 0").groupBy("class").agg(
        F.min(F.when(F.col("keyed"), F.col("row"))).alias("with_keys"), F.min("row").alias("any_row"), F.first("n").alias("n"),
        F.count("*").alias("copies"), F.min("id").alias("least"), F.min(F.struct(no_id, "id", "row")).alias("best"),
    )
    classes = materialize(classes.withColumn("v", F.coalesce("with_keys", "any_row")).drop("with_keys", "any_row"))
    keyed = with_keys.where(F.size("keys") > 0)
    keyed = keyed.join(small(classes.where("copies > 1").select(F.col("class").alias("c"), "v"), COPIED), F.col("class") == F.col("c"), "left")
    keyed = keyed.where("v IS NULL OR v = row").select(F.explode("keys").alias("key"), "row")
    hot = _hot_keys(with_keys)
    crowded = []
    if not hot.isEmpty():
        marked = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
        crowded.append(materialize(marked.where("hot").drop("hot")))
        keyed = marked.where("hot IS NULL").drop("hot")
    group = Window.partitionBy("key")
    shared = materialize(keyed.withColumn("many", F.count("*").over(group)).where("many > 1"))
    maps = materialize(with_keys.where("length(map) > 0").select("row", "n", "map"))
    discard(with_keys)
    others = F.collect_list("row").over(group.orderBy("row").rowsBetween(1 - GROUP, -1))
    pairs = shared.where(F.col("many") <= GROUP).withColumn("others", others).select(F.col("row").alias("a"), F.explode("others").alias("b")).where("a > b").distinct()
    pairs = pairs.join(maps.select(F.col("row").alias("a"), F.col("n").alias("n1"), F.col("map").alias("map1")), "a")
    pairs = pairs.join(maps.select(F.col("row").alias("b"), F.col("n").alias("n2"), F.col("map").alias("map2")), "b")
    tested = pairs.select("a", "b", "n1", "map1", "n2", "map2").mapInArrow(_tested(percent), "a bigint, b bigint")
    crowds = shared.where((F.col("many") > GROUP) & (F.col("many") <= CROWD)).join(maps, "row").select("key", "row", "n", "map")
    crowds = crowds.repartition("key").sortWithinPartitions("key", "n", "row").mapInArrow(_crowd_edges(percent), "a bigint, b bigint")
    crowded = [*crowded, shared.where(F.col("many") > CROWD).select("key", "row")]
    crowded = crowded[0] if len(crowded) == 1 else crowded[0].unionByName(crowded[1])
    least = materialize(crowded.groupBy("key").agg(F.min("row").alias("b"), F.count("*").alias("many")))
    stars = lookup(crowded, least, "key", "many").select(F.col("row").alias("a"), "b").where("a <> b")
    edges = materialize(tested.unionByName(crowds).unionByName(stars).distinct())
    discard(shared)
    clustered = materialize(components(edges).join(classes, "v").select("v", "root", "n", "class", F.col("best.id").alias("id")))

    tiles, large = _tiles(clustered, block_shingles)
    links = materialize(_tile_links(rows, clustered, tiles, k, percent, broadcast_rows))
    labels = components(links)
    if not large.isEmpty():
        late = _late_tiles(large, labels, block_shingles, percent)
        labels = components(links.unionByName(_tile_links(rows, clustered, late, k, percent, broadcast_rows)))

    named = classes.join(labels, "v", "left").withColumn("root", F.coalesce("root", "v"))
    of_root = named.groupBy("root").agg(F.count("*").alias("n_classes"), F.min("least").alias("component_id"), F.min("best").alias("best"))
    of_class = materialize(lookup(named.select("root", "class", "copies"), of_root, "root", "n_classes"))
    by_class = of_class.select("class", "copies", "component_id", F.col("best.row").alias("best_row"))
    some = lookup(found.where("n > 0").drop("keyed"), by_class, "class", "copies")
    some = some.select("id", "n", "component_id", "text_key", (F.col("row") == F.col("best_row")).alias("kept"))
    none = found.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "text_key", F.lit(True).alias("kept"))
    return some.unionByName(none).withColumnsRenamed({"id": "doc_id", "n": "n_shingles"})


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that cluster() keeps, one of each component, with all their columns.

    Rows that go are looked up by id and text hash; while they are few they are broadcast. Of rows repeated with id and text one stays.
    """
    found = cluster(docs, id_col, text_col, k, percent)
    went = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.max("kept").alias("__any"), F.count("*").alias("__n"))
    went = materialize(went.where("NOT __any OR __n > 1"))
    key = fresh(docs, "__text_key")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))

    def same(other: DataFrame):
        return marked[id_col].eqNullSafe(other["__id"]) & (marked[key] == other["__key"])

    stay = marked.join(small(went), same(went), "left_anti")
    repeated = went.where("__any")
    if not repeated.isEmpty():
        empty = F.trim(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == ""
        twice = marked.join(repeated, same(repeated), "left_semi")
        stay = stay.unionByName(twice.where(empty)).unionByName(twice.where(~empty).dropDuplicates([id_col, key]))
    return stay.drop(key)

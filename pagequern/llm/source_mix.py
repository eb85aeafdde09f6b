"""Mixing sources to target weights by Sainte-Lague apportionment.

All sizes are words. The corpus is cut into blocks of equally many words. Blocks go to sources by
highest quotients target / (2a + 1), then each source's blocks to its shards by highest quotients
of the shards' words, so that every shard has an integer quota. What a quota is over the most
repeats of its shard goes, in words, to the source's other shards in order, as far as they have
room, so that a source loses none of its blocks by being thin in each shard. In a shard, a
source's documents lie in seeded order as one stream, again from its start when it ends, and the
first words of that stream are taken.

No row is made for a block: quotients down to a divisor that is certainly too high are counted by
division, and only the few that remain, about 1.5 for each party, are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequern.llm._shared import WORD, fresh, materialize, only

#: A document is never taken more often than this.
MOST_REPEATS = 3
#: A block is 1 / FINENESS of all words, BLOCK_WORDS at most and 1 at least.
FINENESS, BLOCK_WORDS = 65536, 2048
#: Words and rows of one shard, about; sets the number of shards.
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, text_key, skey, size, spot) of every row, written once. skey sorts by code point, null last."""
    found = only(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("skey"),
        F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("spot"),
    )
    return materialize(found)


def targets(sized: DataFrame) -> DataFrame:
    """(skey, place, source_size, target) of each source: weights 1, 2, 3 repeating, filled up to 3 times the size."""
    everything = Window.partitionBy()
    by_key, by_ratio = Window.orderBy("skey"), Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = sized.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_key))
    t = t.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", rest.cast("double") / weights)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))
    t = t.withColumn("level", F.min(fits).over(everything)["level"])
    return t.select("skey", "place", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """parties with a column quota: the seats of each group, dealt by highest quotients votes / (2a + 1).

    seats is the same in all rows of a group. Equal quotients go by key. Without any votes no seat is dealt.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("__all", F.sum(votes).over(whole).cast("double")).withColumn("__k", F.count("*").over(whole))
    share = F.when(F.col("__all") > 0, F.col(votes) / F.col("__all")).otherwise(F.lit(0.0))
    sure = F.floor(share * F.greatest(F.col(seats) - F.col("__k"), F.lit(0)) + 0.5)
    p = p.withColumn("__sure", F.when(F.col(seats) > F.col("__k"), sure).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("__left", F.col(seats) - F.sum("__sure").over(whole))
    more = F.when(share > 0, F.ceil(share * F.col("__k") * 1.5) + 2).otherwise(F.lit(0))
    # sequence(1, 0) would count down, hence the test
    tries = p.withColumn("__a", F.explode(F.when(more > 0, F.sequence(F.lit(0).cast("long"), more - 1)).otherwise(F.array().cast("array<long>"))))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * (F.col("__sure") + F.col("__a")) + 1)), key)
    won = tries.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= F.col("__left"))
    won = won.groupBy(*group, key).agg(F.count("*").alias("__won"))
    out = p.join(won, [*group, key], "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0)))
    return out.drop("__all", "__k", "__sure", "__left", "__won")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    fineness: int = FINENESS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, text_key (xxhash64 of the text).

    A null or empty text has size 0 and nothing of it is taken. A null source is a source of its
    own, the last. Rows that repeat an id are documents of their own; repeats that are alike in
    id, source and size lie side by side. Empty input gives no rows. Other columns are ignored.
    """
    sized = sizes(docs, id_col, text_col, source_col, seed)
    n, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(block_words, words // fineness))
    shards = max(1, -(-(n + words) // shard_words))
    wanted = targets(sized).withColumn("blocks", F.lit((2 * words + block) // (2 * block)).cast("long"))
    wanted = materialize(apportion(wanted, [], "place", "target", "blocks"))

    sized = sized.withColumn("shard", F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") % shards)
    cells = sized.groupBy("skey", "shard").agg(F.sum("size").alias("words"))
    cells = cells.join(wanted.withColumnRenamed("quota", "of_source").drop("blocks"), "skey")
    cells = apportion(cells, ["skey"], "shard", "words", "of_source")
    of_source = Window.partitionBy("skey")
    before = of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("words") * MOST_REPEATS
    cells = cells.withColumn("own", F.least(F.col("quota") * block, most))
    over = F.sum(F.col("quota") * block - F.col("own")).over(of_source) - F.coalesce(F.sum(most - F.col("own")).over(before), F.lit(0))
    cells = cells.withColumn("take", F.col("own") + F.greatest(F.least(over, most - F.col("own")), F.lit(0)))
    cells = cells.select("skey", "shard", "words", "take", "source_size", "target")

    stream = Window.partitionBy("skey", "shard").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(cells, ["skey", "shard"])
    rounds = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    part = F.least(F.greatest(F.col("take") - rounds * F.col("words") - F.col("start"), F.lit(0)), F.col("size"))
    return laid.select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), "text_key")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that mix() takes words of, with all their columns and size, source_size, target, taken.

    Rows repeated with id and text share what is taken of them evenly. Columns of docs that are
    named like the four give way to them.
    """
    bare = docs.drop("size", "source_size", "target", "taken")
    own_id, own_key, key = (fresh(bare, c) for c in ("__id", "__key", "__text_key"))
    plan = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    plan = plan.agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.floor(F.avg("taken")).alias("taken"))
    marked = bare.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    plan = plan.where("taken > 0")
    return marked.join(plan, marked[id_col].eqNullSafe(plan[own_id]) & (marked[key] == plan[own_key])).drop(own_id, own_key, key)

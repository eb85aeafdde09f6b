"""Exact dedup with a heavy-hitter split.

Misra-Gries counters (Spark's frequent-items aggregate, which is that algorithm with mergeable
partial states) find every digest that more than ``support`` of the rows share. An exact count
keeps the real ones: at most ``1 / support`` rows, so they are broadcast and copies of them are
settled where they are read. No other digest can hold more than that share of the rows, so the
rest goes through an ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequern.llm._shared import ascii_lower, fresh, materialize, only, small

#: A digest with more than this share of the rows is a heavy hitter. Bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.0005


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest) of every row, written once; row tells apart rows that repeat an id."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    narrow = only(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"))
    return materialize(narrow.withColumn("row", F.monotonically_increasing_id()))


def heavy_digests(table: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, group_size, winner) of digests with more than support of the rows: 1 / support at most."""
    found = table.stat.freqItems(["digest"], support)
    candidates = found.select(F.explode("digest_freqItems").alias("digest"))
    counted = table.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), _winner())
    return counted.where(F.col("group_size") > F.lit(support * table.count()))


def _winner():
    return F.max(F.struct("doc_id", "row")).alias("winner")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty. Of equal
    texts the row with the largest id stays; a null id is smaller than any other. If a row is
    repeated, id and text, exactly one of the repeats stays. Empty input gives no rows; other
    columns of docs, whatever their names, are ignored.
    """
    table = digest_table(docs, id_col, text_col)
    heavy = materialize(heavy_digests(table, support))
    settled = table.join(F.broadcast(heavy), "digest")
    rest = table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select("digest", "doc_id", "row", F.count("*").over(group).alias("group_size"), F.max(F.struct("doc_id", "row")).over(group).alias("winner"))
    return settled.select(rest.columns).unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that decide() keeps, with all their columns.

    Only rows that go are looked up, by id and digest; while they are few they are broadcast. Rows repeated with id and text, of which one stays, take a separate small path.
    """
    went = decide(docs, id_col, text_col, support).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any_kept"), F.count("*").alias("n"))
    went = materialize(went.where(~F.col("any_kept") | (F.col("n") > 1)))
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    digest = fresh(docs, "__digest")
    marked = docs.withColumn(digest, F.sha2(text, 256))

    def same(other: DataFrame):
        return marked[id_col].eqNullSafe(other["doc_id"]) & (marked[digest] == other["text_sha256"])

    stay = marked.join(small(went), same(went), "left_anti")
    repeated = went.where("any_kept")
    if not repeated.isEmpty():
        twice = marked.join(repeated, same(repeated), "left_semi")
        stay = stay.unionByName(twice.dropDuplicates([id_col, digest]))
    return stay.drop(digest)

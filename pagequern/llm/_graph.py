"""Connected components of a large graph, and lookups of per-key results for skewed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequern.llm._shared import materialize

#: Tables of up to so many edges (16 bytes each) are broadcast when edges are moved; larger ones go by lookup().
BROADCAST_EDGES = 1 << 18
#: Keys with more than this share of the rows, 1 / HEAVY at most, are looked up by broadcast.
HEAVY = 0.0005


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, heavy: float = HEAVY) -> DataFrame:
    """rows joined with table on key; table has a row for each key with n, the number of rows that have it.

    The few keys that hold a large share of rows are broadcast, the others shuffled, so that no task
    gets a hot key. The column n is dropped.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) > F.lit(heavy * total)
    often = F.broadcast(table.where(hot).drop(n))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot).drop(n), key)
    both = rows.join(often, key)
    return both.unionByName(rest.select(both.columns))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) of every vertex on an edge: root is the smallest vertex that it reaches.

    Large-star and small-star steps in turn, each a grouped minimum and a join that spreads the edges
    of a hub, written to the shared folder, until nothing changes: the rounds grow with the logarithm
    of a component's size.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    seen, now = None, state(edges)
    while now != seen:
        few = now[0] <= BROADCAST_EDGES

        def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(least.drop("n")), "a") if few else lookup(rows, least, "a", "n")  # noqa: B023

        # large star: each neighbour that is larger than u hangs on the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        edges = with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = edges if few else materialize(edges)
        # small star: each smaller neighbour, and u itself, hangs on the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = with_least(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        seen, now = now, state(edges)
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())

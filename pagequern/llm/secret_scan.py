"""Secret scan with corpus-wide ownership frequency.

Candidates come from three expressions. Their values are hashed and counted over the whole corpus
by distinct owners and distinct repositories. A value that many owners or many repositories carry
is an example that people copy; a random-looking value that one owner keeps to a few repositories
looks like a live credential. Each verdict adds a span over the value itself: ``live`` or
``copied``. In ``documents`` the owner is the source and a repository is one document of it.

Offsets are code points. No expression looks back, and each walks a text once: it starts where the
last match ended (\\G), takes as little as it can up to the next match, and fails at once elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequern.llm._graph import lookup
from pagequern.llm._shared import materialize, only

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "live", "copied")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: Runs that are too short fail in any case and can hide no longer one, so the length is asked for here.
ACCESS, HEX = r"(AKIA[A-Z0-9]{14,})", r"([0-9a-f]{16,})"
LEAST_VALUE = 12
#: Copied: at least so many owners, or so many repositories. Live: one owner and fewer repositories than that.
COPIED_OWNERS, COPIED_REPOS = 2, 5
#: Live values have at least so many different characters.
LEAST_VARIETY = 8
#: Hashes with more than this share of all candidates, 1 / HEAVY at most, are looked up by broadcast.
HEAVY = 0.001


def _matches(text: Column, kind: int, pattern: str, value_group: int) -> Column:
    """Structs (kind, step, found, value) of the leftmost matches that do not overlap.

    step is how far the match ends after the end of the one before, found the length of the match.
    """
    walk = rf"\G(?s:.*?){pattern}"
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(walk), g).alias(n) for g, n in ((0, "whole"), (1, "found"), (value_group, "value"))))
    rows = F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["whole"]).cast("long").alias("step"), F.length(x["found"]).cast("long").alias("found"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,step:bigint,found:bigint,value:string>>"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, owner, repo, hits) of every row, and (row, owner, repo, kind, start, end, from, value) of every match that counts.

    Offsets are running sums over a row's matches, in a window, so that a text of any number of
    matches takes time in proportion.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.concat(_matches(text, 0, ASSIGN, 2), _matches(text, 1, ACCESS, 1), _matches(text, 2, HEX, 1))
    named = only(docs, *dict.fromkeys((id_col, text_col, owner_col, repo_col)))
    table = materialize(named.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), hits.alias("hits"),
    ))
    each = table.where(F.size("hits") > 0).select("row", "owner", "repo", F.posexplode("hits").alias("i", "h")).select("row", "owner", "repo", "i", "h.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum("step").over(so_far)).where((F.col("kind") > 0) | (F.length("value") >= LEAST_VALUE))
    each = each.select("row", "owner", "repo", "kind", (F.col("end") - F.col("found")).alias("start"), "end", (F.col("end") - F.length("value")).alias("from"), "value")
    return table, materialize(each)


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(digest, n, owners, repos, verdict) of each value; a null owner or repository counts as one of its own.

    found: (digest, owner, repo, variety), a row for each candidate. Three steps of partial sums, so
    that a value which a third of the corpus carries is folded before each shuffle.
    """
    by_repo = found.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"), F.max("variety").alias("variety"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.max("variety").alias("variety"))
    total = by_owner.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("variety").alias("variety"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    verdict = F.when(copied, KINDS.index("copied")).when(F.col("variety") >= LEAST_VARIETY, KINDS.index("live"))
    return total.select("digest", "n", "owners", "repos", verdict.alias("verdict"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, heavy: float = HEAVY,
) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of start, kind, end), n_live, n_copied.

    A null text is empty and has no spans. Rows that repeat an id are scanned each for itself; the
    repeats count as one repository. Two candidates over one value (a hex run in an assignment) give
    one verdict span for each value range. Empty input gives no rows; other columns are ignored.
    """
    table, each = candidates(docs, id_col, text_col, owner_col, repo_col)
    hashed = each.withColumn("digest", F.unhex(F.sha2("value", 256))).withColumn("variety", F.size(F.array_distinct(F.split("value", ""))))
    known = materialize(ownership(hashed.select("digest", "owner", "repo", "variety"), copied_owners, copied_repos))
    values = hashed.select("row", "digest", F.col("from").alias("start"), "end")
    judged = lookup(values, known.select("digest", "n", F.col("verdict").alias("kind")), "digest", "n", heavy)
    added = judged.where("kind IS NOT NULL").select("row", "start", "kind", "end").distinct()

    span = F.struct("start", "kind", "end")
    of_row = each.select("row", "start", "kind", "end").unionByName(added).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < KINDS.index("live"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    with_some = table.where(F.size("hits") > 0).select("row", "doc_id").join(of_row, "row", "left").select("doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "spans")))
    with_none = table.where(F.size("hits") == 0).select("doc_id", none.alias("base"), none.alias("spans"))
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return with_some.unionByName(with_none).select("doc_id", "base", "spans", of_kind("live"), of_kind("copied"))


def digest(found: DataFrame) -> DataFrame:
    """The result of scan() in the columns of the registered query."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )

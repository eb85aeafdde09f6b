"""WARC archives of pages and a Merkle fixity audit of their replicas.

A shard of an archive is a sequence of records, each at an offset. A record's hash is a leaf of the
shard's tree; a node covers FANOUT children and hashes their offset ranges and hashes in order, up
to one root. Two replicas are compared root by root, and only children of nodes that differ are
looked at, level by level, so a sound shard costs one comparison and a damaged record a path.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequern.llm._shared import materialize, only

FANOUT = 16
#: Bytes of a shard, about; sets the number of shards.
SHARD_BYTES = 64 << 20
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC 1.1 resource record as text, but for the last line end; nulls are empty."""
    page_id, url, html = (F.coalesce(c.cast("string"), F.lit("")) for c in (page_id, url, html))
    name = F.md5(F.concat_ws("|", page_id, url))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = [
        F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {_DATE}"), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")), F.lit(""),
    ]
    return F.concat(F.concat_ws(_END, *head), F.lit(_END), html, F.lit(_END))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(page_id, shard, spot, record) of every row. Rows that repeat are records of their own."""
    rows = only(pages, id_col, url_col, html_col).select(F.col(id_col).alias("page_id"), record(F.col(id_col), F.col(url_col), F.col(html_col)).alias("record"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("record") + 2), F.lit(0))).first()[0]
    spot = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    shard = F.conv(F.substring(spot, 1, 8), 16, 10).cast("long") % max(1, -(-total // shard_bytes))
    return rows.select("page_id", shard.alias("shard"), spot.alias("spot"), "record")


def write_warc(found: DataFrame, path: str, compression: str = "none") -> None:
    """Writes records() as one WARC file for each shard, in folders shard=N, in the order of locate(); compression is none or gzip."""
    lines = found.repartition("shard").sortWithinPartitions("shard", "spot", F.sha2(F.concat("record", F.lit(_END)), 256))
    lines.select("shard", "record").write.partitionBy("shard").option("lineSep", _END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start, end, url, body, sha256) of each record of the files that write_warc() wrote.

    Files may be gzip, of one member or one for each record; offsets are those of the text in them.
    A record whose length doesn't lead to a next record ends where the next one begins, and sound
    records after it are read as usual.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [(shard, a, b, *parse(data[a:b]), hashlib.sha256(data[a:b]).hexdigest()) for a, b in bounds(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))], names=["shard", "start", "end", "url", "body", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.where("length > 0").select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "shard bigint, start bigint, end bigint, url string, body binary, sha256 string")


def bounds(data: bytes) -> list[tuple[int, int]]:
    """Start and end of each record of a file."""
    out, at, mark = [], 0, b"WARC/1.1\r\n"
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = next((int(x[15:]) for x in data[at : head if head >= 0 else at].split(b"\r\n") if x.lower().startswith(b"content-length:") and x[15:].strip().isdigit()), None)
        end = head + 4 + size + 4 if size is not None else -1
        if end < 0 or end > len(data) or end < len(data) and not data.startswith(mark, end):
            end = data.find(b"\r\n\r\n" + mark, at + 1)
            end = end + 4 if end >= 0 else len(data)
        out.append((at, end))
        at = end
    return out


def parse(data: bytes) -> tuple[str | None, bytes]:
    """(url, body) of a record."""
    head, _, body = data.partition(b"\r\n\r\n")
    url = next((x[16:].strip().decode(errors="replace") for x in head.split(b"\r\n") if x.lower().startswith(b"warc-target-uri:")), None)
    return url, body.removesuffix(b"\r\n\r\n")


def locate(leaves: DataFrame) -> DataFrame:
    """(shard, spot, n_bytes, sha256, ...) with idx, start and end: the records of a shard by spot, then hash."""
    order = Window.partitionBy("shard").orderBy("spot", "sha256")
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = leaves.withColumn("idx", F.row_number().over(order).cast("long") - 1).withColumn("start", before)
    return placed.withColumn("end", F.col("start") + F.col("n_bytes"))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of all shards, each (shard, idx, start, end, hash), leaves first, roots last."""
    level = materialize(leaves.select("shard", "idx", "start", "end", F.col("sha256").alias("hash")))
    most = level.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0] + 1
    levels = [level]
    while most > 1:
        child = F.struct("idx", "start", "end", "hash")
        parts = F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["start"], c["end"], c["hash"]))
        level = level.groupBy("shard", F.floor(F.col("idx") / fanout).cast("long").alias("parent"))
        level = level.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.concat_ws(",", parts), 256).alias("hash"))
        level = materialize(level.withColumnRenamed("parent", "idx"))
        levels.append(level)
        most = -(-most // fanout)
    return levels


def audit(one: list[DataFrame], other: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(shard, idx, start, end, hash, other_hash) of leaves that differ between two trees.

    A leaf that one side lacks has a null hash on that side and the range of the side that has it.
    The shorter tree's roots are carried up to the height of the other.
    """
    height = max(len(one), len(other))
    one, other = ([*t, *[t[-1]] * (height - len(t))] for t in (one, other))
    # a shorter tree repeats its root level: its index is 0 on every level above
    wrong = None
    for depth in range(height - 1, -1, -1):
        a, b = one[depth], other[depth]
        if wrong is not None:
            parent = F.floor(F.col("idx") / fanout).cast("long")
            seek = wrong.select("shard", F.col("idx").alias("parent"))
            a, b = (x.withColumn("parent", parent).join(seek, ["shard", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.join(b.select("shard", "idx", F.col("start").alias("s"), F.col("end").alias("e"), F.col("hash").alias("other_hash")), ["shard", "idx"], "full_outer")
        differ = ~F.col("hash").eqNullSafe(F.col("other_hash")) | ~F.col("start").eqNullSafe(F.col("s")) | ~F.col("end").eqNullSafe(F.col("e"))
        wrong = materialize(both.where(differ).select("shard", "idx", F.coalesce("start", "s").alias("start"), F.coalesce("end", "e").alias("end"), "hash", "other_hash"))
        if wrong.isEmpty():  # then there is nothing below either
            break
    return wrong


def drill(pages: DataFrame, shard_bytes: int = SHARD_BYTES, every: int = 97, fanout: int = FANOUT) -> DataFrame:
    """A fixity drill on all pages: an archive, a replica with known damage, and what the audit finds.

    One row per page: page_id, shard, start, end, sha256, replica_sha256, damaged. In the replica each
    record whose id in md5 gives a multiple of ``every`` has its lower-case e's replaced by E's, a page
    without any is sound. replica_sha256 and damaged are what the descent through the trees located.
    Null ids, urls and html are empty; empty input gives no rows; other columns are ignored.
    """
    found = records(pages, shard_bytes=shard_bytes)
    hurt = F.conv(F.substring("spot", 9, 8), 16, 10).cast("long") % every == 0
    whole = F.concat("record", F.lit(_END))
    replica = F.when(hurt, F.translate(whole, "e", "E")).otherwise(whole)
    leaves = found.select("page_id", "shard", "spot", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha256"), F.sha2(replica, 256).alias("replica"))
    leaves = materialize(locate(materialize(leaves)))
    mine, theirs = tree(leaves, fanout), tree(leaves.withColumn("sha256", F.col("replica")), fanout)
    wrong = audit(mine, theirs, fanout).select("shard", "idx", "other_hash")
    return leaves.join(wrong, ["shard", "idx"], "left").select(
        "page_id", "shard", "start", "end", "sha256", F.coalesce("other_hash", "sha256").alias("replica_sha256"), F.col("other_hash").isNotNull().alias("damaged"),
    )

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Narrow tables (a few numbers and hashes in a row) of up to so many rows are broadcast.
BROADCAST_ROWS = 1 << 20
#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one on a local master, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="pagequern-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and any executor can read it again."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, once nothing that is still to run reads it.

    Shuffle files of finished jobs go when the driver collects its garbage, so it is asked to.
    """
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count finds so few rows; otherwise it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first name like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; those that df lacks come as null strings, so that callers can rely on them."""
    return df.select(*(df[f"`{n}`"] if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))

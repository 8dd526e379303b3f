"""Intermediates that survive lost executors, and size checks for broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times a compressed file that its rows take in memory, as an upper bound: sorted keys and small counts pack that well.
UNPACKED = 100.0
#: Tables by application, in the order in which they were written.
_KEPT: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: the folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def honest_sizes(spark: SparkSession) -> None:
    """From now on files count as what their rows take in memory, unless the caller has said how much that is.

    A compressed table of millions of rows may have under 10 MB of files.  By these Spark would
    gather it at the driver and broadcast it; the sizes of shuffles, which are true, still let small tables be broadcast.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, str(UNPACKED))


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs no more than the tasks that were
    running.  Call :func:`release` when the results that read the tables are written.
    """
    spark = df.sparkSession
    honest_sizes(spark)
    path = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables :func:`durable` has written in this session after the first ``since`` (see :func:`mark`); returns how many."""
    n, kept = 0, _KEPT.setdefault(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(kept) > since:
        path = jvm.org.apache.hadoop.fs.Path(kept.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def mark(spark: SparkSession) -> int:
    """How many tables there are: a caller that releases since its mark leaves those of others alone."""
    return len(_KEPT.get(spark.sparkContext.applicationId, ()))


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more.

    Without it they stay until the driver happens to collect its garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.select(F.lit(1).alias("one")).limit(rows + 1).count() <= rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

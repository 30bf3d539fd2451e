"""Session facts every operator relies on: the shared folder, written tables, guarded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows, in at most so many bytes as written.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the session is local (tests, a laptop) a
    temporary folder takes its place; on a cluster that is an error, since
    executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="foliomill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage is cut, a lost executor costs nothing that was written, and
    the table's size is known to the planner from then on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliomill/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Bytes of a written table, or the planner's upper estimate of what is made from tables."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``most_bytes`` bytes, else as it is.

    ``df`` should be a materialized table, which is cheap to count and whose
    size is known.  Beyond a bound the planner is left with a shuffled join,
    which gives the same rows.
    """
    fits = written_bytes(df) <= most_bytes and df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if fits else df

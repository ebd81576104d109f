"""Written tables: the points at which a pipeline's result is stored and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, else, on one machine only, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, stored and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a shuffle sorts or groups.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Into how many parts so many rows are shuffled: the session's number, more where a task would have more than TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


#: Rows and bytes of an Arrow batch of long texts.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, where they are larger, for texts that may be very long; Spark knows no other place for it."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def _state(spark: SparkSession, path: str) -> tuple:
    """Files of a table with their sizes and times: another state, another table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def once(spark: SparkSession, name: str, source: str, make) -> DataFrame:
    """The table of that name, made from the table `source` and stored at the first call, and again when `source` has changed."""
    key = (spark.sparkContext.applicationId, name, source, _state(spark, source))
    if key not in _WRITTEN:
        _WRITTEN[key] = written(make(), name)
    return _WRITTEN[key]


def forget() -> None:
    """The next call of `once` makes its table anew."""
    _WRITTEN.clear()

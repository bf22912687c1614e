"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, so that texts of any length reach Python a few at a time.
BATCH_BYTES = 4 << 20
#: Rows that a task sorts, by and large.
TASK_ROWS = 500_000


def short_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session at BATCH_BYTES or less: few wide rows, many narrow ones. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def dealt_by(df: DataFrame, keys: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by the hash of its keys into as many partitions as it takes for about `rows` rows each, and as many as there are cores at least.

    Windows over these keys need no other shuffle, and Spark does not put the partitions together again: what a task sorts stays as
    large as it is however many rows there are, but for a key that has more rows itself. df is counted, which a table of files does by its footers.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *keys)


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names; where that is unset, below one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wireloom-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/wireloom/{sc.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that `written` gave and that nothing will read any more; others are left alone."""
    for t in tables:
        if t is not None and hasattr(t, "written_to"):
            remove(t.sparkSession, t.written_to)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. For callers that have read or written the results they want: results may be read from such tables."""
    remove(spark, scratch_folder(spark))

"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the setting is absent a temporary one on a local master, elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanveil-"))
            current = spark.sparkContext.getCheckpointDir()
        folder = current
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/spanveil/{tag}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


#: Paths that were handed out and not deleted since.
_paths: list[str] = []
#: Spark then removes a write's shuffle files when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while keep() writes: whole texts come to a few MB then.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def keep(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors, has exact sizes for the planner."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = {k: spark.conf.get(k) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before[BATCH]))))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete what keep() wrote; nothing that is still to run may read it."""
    for df in tables:
        _delete(df.sparkSession, df._kept_at)
        if df._kept_at in _paths:
            _paths.remove(df._kept_at)


def mark() -> int:
    """A point in time for release()."""
    return len(_paths)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete all that was written since a mark, once the results that read it are written themselves; but: a table that stays."""
    kept = getattr(but, "_kept_at", None)
    for path in _paths[since:]:
        if path != kept:
            _delete(spark, path)
            _paths.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

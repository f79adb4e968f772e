"""Tables written on the way: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without the setting (tests) gets a fresh folder under /tmp;
    a cluster without it is an error, since no local folder would be seen by all.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors. It goes when the session's JVM ends, if ``drop_written`` hasn't deleted it."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    files, path = _files(spark, place)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, path = _files(spark, name)
        files.delete(path, True)


def hot_keys(counts: DataFrame, n: str = "n", total: int | None = None, least: int = 2) -> DataFrame:
    """Of keys with their numbers of rows, those that would fill a fourth of a task or more: at most four times as many as there are shuffle partitions."""
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    return counts.where(F.col(n) >= max(least, total // (4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``. Only a local session (tests) may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in reliable storage: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """As ``cut``, dealt evenly and not by any key.

    A later join on a key then deals both sides anew, which lets adaptive execution split
    the partition of a hot key.
    """
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """As ``cut``, as a compressed table in the checkpoint folder: for rows with texts."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Between two large steps: has the driver drop the shuffle files of plans that nothing holds any more.

    Spark has no call that deletes a shuffle; its cleaner removes the files when the driver
    collects its garbage, which it may not do for a long time. The second round collects what
    the first has let go. Without a JVM beside this process nothing happens.
    """
    jvm = getattr(spark.sparkContext, "_jvm", None)
    for _ in range(2):
        gc.collect()
        if jvm is not None:
            jvm.System.gc()
            time.sleep(0.2)

"""Tables in the shared folder for what is read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's own folder in the one that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one if that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            there = tempfile.mkdtemp(prefix="lexiforge-")
            atexit.register(shutil.rmtree, there, True)
        sc.setCheckpointDir(there)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: what reads it several times does not compute it again, nor after an executor is lost."""
    shared(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for large tables: a checkpoint has their rows as they are in memory, which is several times as much. Shuffle files of what makes it go at once."""
    spark, path = df.sparkSession, f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)

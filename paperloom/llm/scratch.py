"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is
local (tests) a local temporary folder is made and noted in the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/paperloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends in files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        remove(df.sparkSession, folder)

"""Tables in the folder that all executors see, which end a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which all executors see; it is deleted when the driver ends.

    Where the setting is missing, a session whose executors are threads of the driver gets a folder of its own; any
    other is refused, since its executors would not see a local one.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        where = spark.conf.get("stratalog.shared.dir", None) or tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("stratalog.shared.dir", where)
    where = f"{where.rstrip('/')}/stratalog-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends at a table that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

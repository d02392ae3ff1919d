"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A local session (tests) without the setting gets a temporary
    folder, once; any other must have it, since a folder of one machine would be lost to the others."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidewater.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.tidewater.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what several branches of a plan need is computed
    once, and a lost executor costs only the tasks it ran."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

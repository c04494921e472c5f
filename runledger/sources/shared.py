"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """The name of a folder of its own below spark.checkpoint.dir; a local session without that setting gets one on its machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="runledger-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as a table in a folder of its own: what reads it needs neither its plan nor the executors that computed it."""
    spark, schema, path = df.sparkSession, df.schema, new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)

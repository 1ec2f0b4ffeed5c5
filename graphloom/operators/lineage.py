"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir as the session has it. Only where none is set and the
    session runs on one machine, as in tests, a temporary folder is made and set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if configured or current.isDefined():
        return configured or current.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, removed when the driver ends. The loop survives lost
    executors, each round is computed once, and the files' sizes let the next join choose what to broadcast."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    # the optimiser would derive constraints through unions of self-joins, which fails on shared attributes
    conf, key = spark.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)

"""Session helpers: the shared folder, and durable intermediate results for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local session gets a temporary one; a cluster must name its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="loomgraph-")
    spark.sparkContext.setCheckpointDir(folder)
    return f"file://{folder}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: losing an executor later loses no work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The same as a written table in the shared folder, for rounds that join their own results.

    A checkpoint keeps the estimated size of the plan behind it, and a join multiplies its sides' estimates; over some
    rounds that number alone takes longer than the work. A table has the size of its files, so small ones are broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and continue from its files.

    The cluster names the folder in spark.checkpoint.dir. Only where that is unset (tests, a laptop) is a
    temporary folder set, since such a session has a single machine. A written table is compressed and read by column, and what
    follows survives the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(named)
        folder = context._jsc.sc().getCheckpointDir()
    path = f"{folder.get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows; else for a shuffled join. `df` should be cheap to count."""
    small = df.limit(rows + 1).count() <= rows
    return df.hint("broadcast") if small else df.hint("merge")

"""Results that are written to the folder that driver and executors share, so that what follows starts from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _with_folder(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(own or "file://" + tempfile.mkdtemp(prefix="lexiloom-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the folder that ``spark.checkpoint.dir`` names; a new local one is taken only where that is unset and driver and executors are one process, as in tests."""
    _with_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in that folder, for a table that several branches of a plan read: each takes the columns that it needs, none makes the table again. The files go when the JVM ends."""
    _with_folder(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)

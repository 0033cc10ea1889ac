"""Tables that a query writes once and reads again, below ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share. Without ``spark.checkpoint.dir`` only a session on
    this machine alone has one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reclink-")
        spark.sparkContext.setCheckpointDir(base)
    _WRITTEN.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame and read it back: lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete this process's scratch folders; frames that read them must have been used."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    gone = len(_WRITTEN)
    _WRITTEN.clear()
    return gone

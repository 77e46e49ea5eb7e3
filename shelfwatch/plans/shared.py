"""Where durable intermediate data goes: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session may fall back to a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="shelfwatch-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def durable(rows: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder, so a lost executor costs no replay of earlier rounds."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """Like ``durable``, for wide rows: compressed columns in the shared folder, of which readers take what they need."""
    folder = f"{shared_dir(rows.sparkSession)}/stored-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)

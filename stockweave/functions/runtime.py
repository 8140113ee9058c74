"""Where intermediate tables live and how lineage is cut.

Iterative jobs write each round as a Parquet table in the shared folder the cluster names in
``spark.checkpoint.dir``. A lost executor then re-reads files instead of recomputing the rounds before it,
each round is computed once, and the optimizer sees real sizes when it picks the joins of the next round.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is made only for a local master that has none."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster, whose executors have folders of their own
            raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="stockweave-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows once to the shared folder and go on from the files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

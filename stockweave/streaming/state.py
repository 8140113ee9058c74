"""Spark's own keyed state for the streams: where it is kept and how it is read.

The streams keep what they know in state variables on the RocksDB store, under the query's checkpoint folder. A batch touches the keys of its own rows only, however
many batches went before; nothing expires. Each call of a state variable is a round trip between Python and the JVM, so orders, payments and skus are kept by bucket: a list of
the entities of one bucket is read, and written back, by one call. Sinks are file sinks with Spark's commit log, so a batch that is run again leaves each row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 1024  # keys of a state, fixed for the life of a query


def bucket(entity) -> Column:
    """The key under which the state of ``entity`` is kept."""
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def use_rocks(spark: SparkSession) -> None:
    """Keyed state variables need this provider; a query keeps the one it started with."""
    spark.conf.set(PROVIDER, ROCKS)


def started(spark: SparkSession, folder: str) -> bool:
    """Whether a batch of the query with checkpoint ``folder`` was committed."""
    try:
        return not spark.read.format("state-metadata").load(folder).isEmpty()
    except Exception as e:  # no such folder, or nothing committed in it
        if "STDS" in str(e) or "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "No such file" in str(e):
            return False
        raise


def read_variable(spark: SparkSession, folder: str, operator: int, name: str) -> DataFrame:
    """Rows (key, value) of a state variable after the last batch; operators are numbered from the sink, the one nearest to it being 0."""
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(folder)


def start(rows: DataFrame, path: str, progress: str, trigger: dict | None = None):
    """Append the rows of a stream to Parquet files under ``path``, each once."""
    return (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())

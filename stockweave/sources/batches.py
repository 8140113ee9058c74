"""A table that is replaced as a whole: numbered snapshots, of which readers take the last complete one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """Each write is a new snapshot ``folder/batch=N``; one without a success marker was not finished and is not read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        marks = fs.globStatus(path(f"{self.folder}/batch=*/_SUCCESS")) or []
        return sorted(int(m.getPath().getParent().getName().split("=")[1]) for m in marks)

    def fetch(self) -> DataFrame | None:
        numbers = self.numbers()
        return self.spark.read.parquet(f"{self.folder}/batch={numbers[-1]}") if numbers else None

    def replace(self, df: DataFrame) -> DataFrame:
        numbers = self.numbers()
        path = f"{self.folder}/batch={numbers[-1] + 1 if numbers else 0}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

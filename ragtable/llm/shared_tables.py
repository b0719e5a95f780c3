"""Tables written to the shared folder of ``spark.checkpoint.dir`` between jobs, and removed when read for the last time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


class SharedTable:
    """A DataFrame written once as Parquet; every reader, and every retry of a lost task, reads the same rows."""

    def __init__(self, rows: DataFrame, name: str):
        self.spark: SparkSession = rows.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(self.folder)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

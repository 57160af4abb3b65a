"""The folder for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master, as in tests, may do without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Checkpoints:
    """Tables between steps, as checkpoints."""

    def keep(self, df: DataFrame) -> DataFrame:
        return checkpoint(df)

    def drop(self, *tables: DataFrame) -> None:
        """Checkpoints stay until their folder is cleared."""


class Tables:
    """Tables between steps, written to the shared folder and read back.

    Unlike checkpoints they carry no constraints of the plans that made them, which a loop would pile up.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

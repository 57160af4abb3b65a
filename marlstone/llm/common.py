"""Scratch tables and sorted-group streaming shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.scratch import shared_folder

#: Words are maximal runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written for reuse, in the shared folder that ``spark.checkpoint.dir`` names.

    Written tables cut lineage and survive lost executors. They stay until that folder is cleared, or ``drop`` lets them go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _numbers(self, tables: tuple[DataFrame, ...]) -> set[int]:
        """The numbers of this scratch's tables that some tables read."""
        mark = f"/{self.root.rpartition('/')[2]}/"
        return {int(f.rpartition(mark)[2].partition("/")[0]) for t in tables for f in t.inputFiles() if mark in f}

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for number in self._numbers(tables):
            self._delete(number)

    def clear(self, *kept: DataFrame) -> None:
        """Delete all written tables but those that ``kept`` read."""
        still = self._numbers(kept)
        for number in range(1, self.made + 1):
            if number not in still:
                self._delete(number)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from a partition sorted by them.

    Only the group being read is held; callers bound the size of groups.
    """
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        lo = 0
        for i, row in enumerate(rows):
            if row != current:
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                if held:
                    yield pa.Table.from_batches(held)
                held, lo, current = [], i, row
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)

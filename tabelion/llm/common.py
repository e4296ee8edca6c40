"""What the training-data operators share: the shared folder, written stages and Arrow limits."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.session import shared_dir

#: A word of the contracts: anything but space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z to a-z and nothing else, in UTF-8 as well as in ASCII.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


class Stages:
    """Tables written in the shared folder, so that lost executors cost only the stage they ran in."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n, self.tables = spark, 0, []
        self.root = f"{shared_dir(spark)}/tabelion/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """df written as Parquet and read again; its lineage ends here."""
        self.n += 1
        path = f"{self.root}/{self.n}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        gc.collect()  # plans of earlier stages go, and with them, at the JVM's next collection, their shuffle files
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, label: str, n: int, column: str, part: str) -> tuple[DataFrame, str]:
        """df written in partitions of one column and n buckets of another, so that joins on it move the other side only.

        Returns the table and its folder. The table lives until forget().
        """
        name, path = f"tabelion_{uuid.uuid4().hex}", self.path(label)
        df.write.option("path", path).partitionBy(part).bucketBy(n, column).saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name), path

    def forget(self) -> None:
        """Takes bucketed tables off the catalog and deletes their files."""
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE {name}")
            self.delete(path)
        self.tables = []

    def delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Deletes all that was kept, where nothing lazy reads it any more."""
        self.forget()
        self.delete(self.root)

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{label}"

    def drop(self, *tables: DataFrame) -> None:
        """Deletes kept tables that no later step reads."""
        for table in tables:
            for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                self.delete(root)


def arrow_limits(spark: SparkSession, rows: int = 512) -> None:
    """Bounds a batch that goes to Python, so that very long texts don't add up."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        spark.conf.set(key, str(value))


#: Rows of identifiers that are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def sent(ids: DataFrame) -> DataFrame:
    """ids, sent to all tasks if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

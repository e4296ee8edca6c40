"""A session with the settings the library expects (an existing session is used as it is), and the folder that a job's tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of each application without spark.checkpoint.dir in local mode: its own folder.
_own: dict[str, str] = {}


def session(name: str = "tabelion") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Spark reads it by, so that readers beside Spark find the same files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tabelion-"))
    return qualified(spark, at.rstrip("/"))


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, for what several jobs read: its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/tabelion/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

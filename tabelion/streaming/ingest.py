"""Incremental ingestion: landed raw rows, or the paged sources themselves -> micro-batches -> keyed upserts.

A landing folder holds raw rows as JSON, written by a collector that keeps nothing else. The checkpoint is the cursor:
a batch that is repeated after a failure upserts the same keys, so each row counts once. Original text lives in the landing
folder only until its batch is done (cleanSource).

Live streams read the sources directly: their offsets are the sources' own cursors (paged.py), so a query that is started again goes on
after its last whole batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabelion.functions.courts import select
from tabelion.sources import convert, paged
from tabelion.sources.config import Job
from tabelion.sources.corpus import Corpus
from tabelion.sources.paged import ROW


def landed(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", "delete").json(folder)


def live(spark: SparkSession, source: str, job: Job, transport: str | None = None, **options: str) -> DataFrame:
    """The rows of a paged source as a stream."""
    paged.register(spark)
    query = job.datajud if source == "court_cases" else job.djen
    return spark.readStream.format(source).options(**paged.options(query, select(job.tribunais), {}, transport), **options).load()


def run(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the stream over all that has landed; awaitTermination() ends when it is done."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a live stream that asks again as soon as a batch is done, or at an interval; processAllAvailable() waits until there is nothing new."""
    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer).start()


def case_upserts(job: Job, corpus: Corpus) -> Callable[[DataFrame, int], None]:
    def upsert(batch: DataFrame, epoch: int) -> None:
        corpus.upsert_cases(convert.cases(batch, job.datajud).withColumn("__arrived", F.col("proveniencia.coletado_em")).drop("cursor"))

    return upsert


def notice_upserts(job: Job, corpus: Corpus) -> Callable[[DataFrame, int], None]:
    def upsert(batch: DataFrame, epoch: int) -> None:
        rows = convert.notices(batch, job.djen)
        corpus.upsert_documents((rows if job.incluir_sensiveis else rows.where(~F.col("sensivel"))).withColumn("__arrived", F.col("proveniencia.coletado_em")))

    return upsert


def cases(spark: SparkSession, job: Job, corpus: Corpus, folder: str, checkpoint: str) -> StreamingQuery:
    return run(landed(spark, folder), case_upserts(job, corpus), checkpoint)


def notices(spark: SparkSession, job: Job, corpus: Corpus, folder: str, checkpoint: str) -> StreamingQuery:
    return run(landed(spark, folder), notice_upserts(job, corpus), checkpoint)


def live_cases(spark: SparkSession, job: Job, corpus: Corpus, checkpoint: str, transport: str | None = None, **options: str) -> StreamingQuery:
    """Case records straight from the index into the corpus."""
    return follow(live(spark, "court_cases", job, transport, **options), case_upserts(job, corpus), checkpoint)


def live_notices(spark: SparkSession, job: Job, corpus: Corpus, checkpoint: str, transport: str | None = None, **options: str) -> StreamingQuery:
    """Notices, day after day, into the corpus. A limit of documents a court is the batch collection's alone."""
    return follow(live(spark, "court_notices", job, transport, **options), notice_upserts(job, corpus), checkpoint)

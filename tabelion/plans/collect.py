"""Collection jobs over the paged sources and folders, court by court, resumable."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.functions.courts import select
from tabelion.operators import paging
from tabelion.sources import convert, files, paged
from tabelion.sources.config import Job
from tabelion.sources.corpus import Corpus

#: Pages of a court, and days of all courts, that a round takes.
PAGES, DAYS = 20, 7


def _open(corpus: Corpus, source: str, job: Job) -> tuple[list[str], dict]:
    """Courts that aren't done, and where to go on."""
    state = corpus.cursors(source, job.nome)
    courts = [c for c in select(job.tribunais) if not state.get(c, (None, False))[1]]
    return courts, {c: state[c][0] for c in courts if c in state and state[c][0] is not None}


def cases(spark: SparkSession, job: Job, corpus: Corpus, transport: str | None = None, pages: int = PAGES) -> int:
    """Collects, classifies and stores case records; the number of rows stored.

    A round takes at most so many pages of each court, stores them, then saves where each court goes on, in this order:
    a job that dies goes on after its last whole round, and rows that are fetched again replace themselves.
    """
    paged.register(spark)
    every, _ = _open(corpus, "datajud", job)
    if not every:
        return 0
    while True:
        courts, cursors = _open(corpus, "datajud", job)
        if not courts:
            break
        raw = spark.read.format("court_cases").options(**paged.options(job.datajud, courts, cursors, transport), pages=str(pages)).load().persist()
        try:
            corpus.upsert_cases(convert.cases(raw, job.datajud).withColumn("__arrived", F.col("proveniencia.coletado_em")).drop("cursor"))
            at = F.from_json("cursor", "page int, seen long")
            last = {r["tribunal"]: json.loads(r["cursor"]) for r in raw.groupBy("tribunal").agg(F.max_by("cursor", at["page"]).alias("cursor")).collect()}
        finally:
            raw.unpersist()
        # a court that gave fewer pages than asked for has no more
        corpus.save_cursors("datajud", job.nome, {c: (last.get(c, cursors.get(c)), c not in last or last[c]["page"] < pages) for c in courts})
    return corpus.read("processos").where(F.col("tribunal").isin(*every)).count()


def notices(spark: SparkSession, job: Job, corpus: Corpus, transport: str | None = None, days: int = DAYS) -> int:
    """Collects notices; at most limite_por_tribunal accepted documents a court. Sensitive ones only if the job says so.

    A round takes so many days of all courts; as with cases, cursors are saved after the documents.
    """
    paged.register(spark)
    every, _ = _open(corpus, "djen", job)
    if not every:
        return 0
    while True:
        courts, cursors = _open(corpus, "djen", job)
        if not courts:
            break
        ahead = {c: [d.isoformat() for d in paged.days(job.djen, date.fromisoformat(cursors[c]["day"]) if c in cursors else None)] for c in courts}
        raw = spark.read.format("court_notices").options(**paged.options(job.djen, courts, {c: d[:days] for c, d in ahead.items()}, transport)).load()
        rows = convert.notices(raw, job.djen)
        rows = rows if job.incluir_sensiveis else rows.where(~F.col("sensivel"))
        accepted = {c: cursors.get(c, {}).get("accepted", 0) for c in courts}
        rows = rows.persist()
        try:
            kept, most = rows.withColumn("__arrived", F.col("proveniencia.coletado_em")), job.djen.limite_por_tribunal
            if most is not None:
                left = F.create_map(*(F.lit(x) for c in courts for x in (c, most - accepted[c])))
                kept = paging.first_of_each(kept, "tribunal", ["data", "id"], left[F.col("tribunal")])
            corpus.upsert_documents(kept)
            found = {r["tribunal"]: r["n"] for r in rows.groupBy("tribunal").agg(F.count_distinct("id").alias("n")).collect()}
        finally:
            rows.unpersist()
        after = {}
        for c in courts:
            n = accepted[c] + found.get(c, 0)
            more = len(ahead[c]) > days and (most is None or n < most)
            after[c] = ({"day": ahead[c][days] if len(ahead[c]) > days else ahead[c][-1], "accepted": n if most is None else min(n, most)}, not more)
        corpus.save_cursors("djen", job.nome, after)
    return corpus.read("documentos").where(F.col("tribunal").isin(*every)).count()


def folder(spark: SparkSession, path: str, corpus: Corpus) -> tuple[int, DataFrame]:
    """Stores the decisions of a folder; the number of documents and the failures."""
    rows, failures = files.read(spark, path)
    corpus.upsert_documents(convert.documents(rows, source="arquivo"))
    return corpus.read("documentos").where("fonte = 'arquivo'").count(), failures


def estimate(job: Job, transport: str | None = None) -> dict[str, int]:
    """Records that match in each court, before the filing period."""
    client = paged.Client(paged._transport(transport), interval=0 if transport else 1)
    return {c: paged.case_count(client, c, job.datajud) for c in select(job.tribunais)}

"""Commands: analisar, pseudonimizar, tribunais, estimar, coletar, sondar, classificar, amostra, validar, relatorio."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tabelion.functions import courts
from tabelion.operators import decisions, pseudonyms, validate
from tabelion.plans import collect, document, report
from tabelion.session import session
from tabelion.sources import config, files, paged
from tabelion.sources.corpus import Corpus


def text_of(path: str) -> str:
    found, why = files.extracted(path, Path(path).read_bytes())
    if found is None:
        raise SystemExit(f"{path}: {why}")
    return found


def analyse(a: argparse.Namespace) -> None:
    spark = session()
    plain = pseudonyms.pseudonymised(spark.createDataFrame([(text_of(a.arquivo),)], "t string"), "t").first()["p"]["texto"]
    found = document.analyse_text(spark, plain)
    if a.svg:
        Path(a.svg).write_text(document.drawing(found), encoding="utf-8")
    print(found)


def pseudonymise(a: argparse.Namespace) -> None:
    p = pseudonyms.pseudonymised(session().createDataFrame([(text_of(a.arquivo),)], "t string"), "t").first()["p"]
    print(p["texto"])
    print(json.dumps(p["substituicoes"], ensure_ascii=False), file=sys.stderr)


def list_courts(a: argparse.Namespace) -> None:
    for court in courts.select(a.criterios):
        print(court, courts.COURTS[court])


def estimate(a: argparse.Namespace) -> None:
    found = collect.estimate(config.load(a.recorte), a.transporte)
    print(json.dumps(found | {"total": sum(found.values())}, indent=1))


def gather(a: argparse.Namespace) -> None:
    spark = session()
    corpus = Corpus(spark, a.corpus)
    if a.fonte == "arquivos":
        n, failures = collect.folder(spark, a.recorte, corpus)
        for row in failures.toLocalIterator():
            print(row["path"], row["erro"], file=sys.stderr)
    else:
        n = (collect.cases if a.fonte == "datajud" else collect.notices)(spark, config.load(a.recorte), corpus, a.transporte)
    print(n)


def probe(a: argparse.Namespace) -> None:
    client = paged.Client(paged._transport(a.transporte))
    hits, _, _ = next(paged.case_pages(client, a.tribunal, config.CaseQuery(tamanho_pagina=1, limite_por_tribunal=1)), ([], None, None))
    print(json.dumps(sorted(hits[0]["_source"]) if hits else []))


def classify(a: argparse.Namespace) -> None:
    corpus = Corpus(session(), a.corpus)
    fresh = decisions.reclassified(corpus.documents(True))
    # counted as the rows are written
    print(corpus.upsert("documentos", fresh, counters={"mudaram": F.count_if("mudou")}, without=["mudou"]))


def sample(a: argparse.Namespace) -> None:
    docs = Corpus(session(), a.corpus).documents()
    chosen = validate.stratified(docs, "resultado", a.tamanho, "id").withColumn("s", decisions.sections(F.col("texto")))
    ruling = F.substring(F.concat_ws("\n---\n", "s.decisao_colegiada", F.nullif("s.dispositivo", F.lit(""))), 1, 1500)
    listed = F.array_join(F.transform("avaliacao.capitulos", lambda c: F.concat(c["objeto"], F.lit(": "), c["resultado"])), "; ")
    rows = chosen.select("id", "tribunal", "tipo", ruling.alias("dispositivo"), F.col("resultado").alias("resultado_automatico"), "avaliacao.confianca", F.coalesce("avaliacao.motivo", F.lit("")).alias("motivo"), listed.alias("capitulos"), F.lit("").alias("resultado_manual"))
    report.write_csv(Path(a.saida), [r.asDict() for r in rows.orderBy(F.xxhash64("id")).collect()])


def check(a: argparse.Namespace) -> None:
    rows = session().read.csv(a.arquivo, header=True, multiLine=True, escape='"')
    matrix = validate.confusion(validate.labelled(rows)).persist()
    if not matrix.count():
        raise SystemExit("no row has a label")
    print(json.dumps(validate.accuracy(matrix).first().asDict() | {"rotulos": [r.asDict() for r in validate.label_metrics(matrix).collect()]}, ensure_ascii=False, indent=1))


def publish(a: argparse.Namespace) -> None:
    job = config.load(a.recorte) if a.recorte else config.Job("relatório")
    print(report.generate(Corpus(session(), a.corpus), a.saida, job.nome, job.descricao, a.incluir_sensiveis))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabelion", description=__doc__)
    commands = top.add_subparsers(required=True)

    def add(name: str, run, *arguments: tuple) -> None:
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        for flags, options in arguments:
            command.add_argument(*flags.split(), **options)

    corpus, transport = ("--corpus", {"default": "corpus"}), ("--transporte", {"help": "module:function instead of the network"})
    add("analisar", analyse, ("arquivo", {}), ("--svg", {"help": "file to draw the frequent words in"}))
    add("pseudonimizar", pseudonymise, ("arquivo", {}))
    add("tribunais", list_courts, ("criterios", {"nargs": "*"}))
    add("estimar", estimate, ("recorte", {}), transport)
    add("coletar", gather, ("fonte", {"choices": ["datajud", "djen", "arquivos"]}), ("recorte", {"help": "job file, or a folder for arquivos"}), corpus, transport)
    add("sondar", probe, ("tribunal", {}), transport)
    add("classificar", classify, corpus)
    add("amostra", sample, ("saida", {}), ("--tamanho", {"type": int, "default": 100}), corpus)
    add("validar", check, ("arquivo", {}))
    add("relatorio", publish, ("saida", {}), ("--recorte", {}), ("--incluir-sensiveis", {"action": "store_true"}), corpus)
    return top


def main(arguments: list[str] | None = None) -> None:
    chosen = parser().parse_args(arguments)
    chosen.run(chosen)


if __name__ == "__main__":
    main()

"""The analysis of decisions one by one, with the same functions for one text as for a table of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.functions import courts, text
from tabelion.operators import amounts, citations, decisions


def analyse(documents: DataFrame, column: str = "texto", top: int = 20) -> DataFrame:
    """documents with evaluation, numbers, sizes, citations, terms, arguments, words and parameters of each text."""
    d = documents.withColumn("t", text.tidy(F.coalesce(F.col(column), F.lit(""))))
    d = d.withColumns({"secoes": decisions.sections(F.col("t")), "avaliacao": decisions.evaluation(F.col("t"))}).withColumn("calculo", amounts.calculation(F.col("avaliacao.dispositivo")))
    refs, words = citations.cited(F.col("t"))["referencia"], text.telling_tokens(F.col("t"))
    d = d.withColumns({"refs": refs, "palavras": words}).withColumns({"refs": F.array_sort("refs"), "palavras": F.array_sort("palavras")})  # columns, as functions of arrays take no Python functions
    ranked = F.array_sort(F.transform(text.runs(F.col("palavras")), lambda r: F.struct((-r["n"]).alias("n"), r["item"].alias("palavra"))))
    ranked = F.slice(F.transform(ranked, lambda e: F.struct(e["palavra"], (-e["n"]).alias("n"))), 1, top)
    return d.withColumns({
        "numeros_processo": courts.case_numbers(F.col("t")), "citacoes": F.map_from_entries(text.runs(F.col("refs"))), "termos_juridicos": text.term_counts(F.col("t")),
        "argumentos": text.arguments(F.coalesce(F.nullif(F.col("secoes.fundamentacao"), F.lit("")), F.col("t"))), "palavras_frequentes": ranked,
        "tamanho": F.create_map(F.lit("caracteres"), F.length("t"), *(x for n in ("relatorio", "fundamentacao", "dispositivo") for x in (F.lit(n), F.length(f"secoes.{n}")))),
    }).drop("t", "secoes", "refs", "palavras")


def analyse_text(spark: SparkSession, decision: str) -> str:
    """The analysis of one text as JSON."""
    row = analyse(spark.createDataFrame([(decision,)], "texto string")).drop("texto")
    return row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]


def drawing(analysis: str) -> str:
    """The frequent words of an analysis, as given by analyse_text, drawn as SVG."""
    from tabelion.plans.report import bars

    return bars(json.loads(analysis)["palavras_frequentes"], "palavra", "n").replace("<svg ", '<svg xmlns="http://www.w3.org/2000/svg" font-size="12" ', 1)

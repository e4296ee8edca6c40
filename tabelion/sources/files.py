"""Local or shared folders of decisions: PDF, DOCX, text and HTML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.functions import courts

KINDS = ("pdf", "docx", "txt", "html", "htm")
_PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as packed:
        root = ElementTree.fromstring(packed.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_PARAGRAPH}t")) for p in root.iter(f"{_PARAGRAPH}p"))


def pdf_text(data: bytes) -> str:
    """Pages of a PDF, where the optional reader is installed."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def extracted(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, None) or (None, why not)."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind == "pdf":
            found = pdf_text(data)
        elif kind == "docx":
            found = docx_text(data)
        elif kind in ("txt", "html", "htm", "md"):
            found = data.decode("utf-8", errors="replace")
        else:
            return None, f"unknown kind: {kind}"
    except Exception as error:  # a damaged file is a row with a reason, not the end of the job
        return None, f"{type(error).__name__}: {error}"
    return (found, None) if found.strip() else (None, "no text")


def text_of(path: Column, content: Column) -> Column:
    @F.pandas_udf("texto string, erro string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents in batches:
            yield pd.DataFrame([extracted(p, c) for p, c in zip(paths, contents, strict=True)], columns=["texto", "erro"])

    return run(path, content)


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows for convert.documents, failures (path, erro)); identifier from the content, number from the text."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    binary = binary.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*KINDS))
    read_ = binary.withColumn("t", text_of(F.col("path"), F.col("content")))
    # a number that later expressions can't spell out again each time they name it
    number = F.when(F.monotonically_increasing_id() >= 0, F.get(courts.case_numbers(F.col("t.texto")), F.lit(0)))
    known, number = read_.where("t.erro is null").withColumn("n", number), F.col("n")
    rows = known.select(
        F.substring(F.sha2("content", 256), 1, 32).alias("chave"), courts.court_of_number(number).alias("tribunal"), number.alias("numero"), F.lit(None).cast("string").alias("tipo"), F.lit(None).cast("date").alias("data"),
        F.lit(None).cast("string").alias("classe_nome"), F.col("path").alias("url"), F.array().cast("array<string>").alias("nomes"), F.col("t.texto").alias("bruto"),
        F.lit(None).cast("struct<url:string,metodo:string,parametros:string,coletado_em:string,sha256:string>").alias("proveniencia"),
    )
    return rows, read_.where("t.erro is not null").select("path", F.col("t.erro").alias("erro"))

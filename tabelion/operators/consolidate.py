"""One unit per case and instance, from decision texts and case movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.functions import movements as m
from tabelion.functions.text import digits, first_given

# Degrees of the first, second and superior instance, and the degree that stands for an instance.
FIRST, SECOND, SUPERIOR = ("G1", "JE"), ("G2", "TR"), ("SUP", "STJ", "TST", "TSE", "STM", "TS")
DEGREE = {"1": "G1", "2": "G2", "3": "SUP"}


def instance_of_degree(degree: Column) -> Column:
    degree = F.upper(degree)
    return F.when(degree.isin(*FIRST), "1").when(degree.isin(*SECOND), "2").when(degree.isin(*SUPERIOR), "3")


def instance_of_document(kind: Column, outcome: Column) -> Column:
    """By the type of the decision, else by its outcome; motions for clarification have none."""
    return (
        F.when(kind == "embargos_declaracao", F.lit(None).cast("string")).when(kind == "sentenca", "1").when(kind.isin("acordao", "decisao_monocratica"), "2")
        .when(outcome.isin(*m.MERIT, "extinto_sem_merito", "homologacao_acordo"), "1").when(outcome.isin(*m.APPEAL_MERIT, "nao_conhecido"), "2")
    )


def first_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. min_by of the row combines before the shuffle, so no key's rows meet in one task."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def consolidate(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """cases: tribunal, numero, grau, classe_nome, assuntos, data_ajuizamento, data_julgamento, duracao_dias, resultado, sensivel.
    documents: id, tribunal, numero, data, classe_nome, resultado, sensivel, avaliacao (struct), calculo (struct).

    The text's outcome prevails, movements fill in what it leaves open; both determined and different is divergent. Of
    several texts the first determined one by date counts, of several case rows the earliest judged (degree and court
    break ties, so that the result doesn't depend on the order of rows). A number's court is not part of the key.
    """
    texts = documents.withColumn("instancia", instance_of_document(F.col("avaliacao.tipo_decisao"), F.col("resultado"))).where("instancia is not null")
    number = digits(F.col("numero"))
    texts = texts.withColumn("chave", F.when(number == "", F.concat(F.lit("doc:"), F.col("id"))).otherwise(number))
    texts = first_rows(texts, ["chave", "instancia"], F.col("resultado") == m.UNDETERMINED, F.coalesce(F.col("data").cast("string"), F.lit("9999")), F.col("id"))
    moves = cases.withColumn("instancia", instance_of_degree(F.col("grau"))).where("instancia is not null").withColumn("chave", digits(F.col("numero")))
    moves = first_rows(moves, ["chave", "instancia"], F.col("data_julgamento").isNull(), F.col("data_julgamento"), F.col("grau"), F.col("tribunal"))
    d = texts.select("chave", "instancia", F.struct(*[c for c in texts.columns if c not in ("chave", "instancia")]).alias("d"))
    p = moves.select("chave", "instancia", F.struct(*[c for c in moves.columns if c not in ("chave", "instancia")]).alias("p"))
    both = d.join(p, ["chave", "instancia"], "full_outer")
    said, moved = F.col("d.resultado"), F.col("p.resultado")
    settled = lambda c: F.coalesce(c != m.UNDETERMINED, F.lit(False))
    source = F.when(settled(said), "texto").when(settled(moved), "movimentos").when(F.col("d").isNotNull(), "texto").otherwise("movimentos")
    from_text = source == "texto"
    return both.select(
        F.col("chave").alias("numero"), "instancia",
        first_given(F.col("d.tribunal"), F.col("p.tribunal")).alias("tribunal"),
        F.coalesce(first_given(F.col("p.grau")), *(F.when(F.col("instancia") == k, v) for k, v in DEGREE.items())).alias("grau"),
        first_given(F.col("p.classe_nome"), F.col("d.classe_nome")).alias("classe_nome"),
        F.coalesce("p.assuntos", F.array().cast(cases.schema["assuntos"].dataType)).alias("assuntos"),
        F.col("p.data_ajuizamento").alias("data_ajuizamento"),
        F.coalesce(F.col("p.data_julgamento").cast("string"), F.col("d.data").cast("string")).alias("data_julgamento"),
        F.col("p.duracao_dias").alias("duracao_dias"),
        F.when(settled(said), said).when(settled(moved), moved).otherwise(m.UNDETERMINED).alias("resultado"),
        said.alias("resultado_texto"), moved.alias("resultado_movimentos"), F.col("d.avaliacao.resultado_acao").alias("resultado_acao"),
        F.when(F.col("d").isNotNull() & F.col("p").isNotNull(), "ambos").otherwise(source).alias("fonte"), source.alias("fonte_resultado"),
        (settled(said) & settled(moved) & (said != moved)).alias("divergente"),
        F.when(from_text, F.col("d.avaliacao.confianca")).otherwise("media").alias("confianca"),
        F.when(from_text, F.col("d.avaliacao.motivo")).alias("motivo"),
        F.col("d.avaliacao.capitulos").alias("capitulos"), F.col("d.calculo").alias("calculo"),
        (F.coalesce("d.sensivel", F.lit(False)) | F.coalesce("p.sensivel", F.lit(False))).alias("sensivel"),
    )


def latest(df: DataFrame, keys: list[str], arrived: str) -> DataFrame:
    """Last write wins for each key; the last is found before the shuffle, as in first_rows."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(arrived)).alias("__row")).select("__row.*")

"""Outcome of a case from its movements, by code or name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabelion.functions.text import unaccent

# Outcome labels, movement codes, and name patterns in order.
OUTCOMES = (
    "procedente", "parcialmente_procedente", "improcedente", "extinto_sem_merito", "homologacao_acordo", "provido",
    "parcialmente_provido", "nao_provido", "nao_conhecido", "indeterminado",
)
MERIT = ("procedente", "parcialmente_procedente", "improcedente")
GRANTED = ("procedente", "parcialmente_procedente")
APPEAL_MERIT = ("provido", "parcialmente_provido", "nao_provido")
REVERSED = ("provido", "parcialmente_provido")
UNDETERMINED = "indeterminado"
CODES = {219: "procedente", 220: "improcedente", 221: "parcialmente_procedente", 11376: "extinto_sem_merito", 11377: "extinto_sem_merito", 11378: "extinto_sem_merito"}
IGNORED = (
    r"embargos de declaracao|liminar|tutela|antecipacao|justica gratuita|assistencia judiciaria|impugnacao ao valor|"
    r"excecao|incidente|cumprimento de sentenca"
)
NAMES = (
    ("parcialmente_procedente", r"procedencia em parte|procedente em parte"),
    ("improcedente", r"\bprescricao\b|\bdecadencia\b|renuncia a pretensao"),
    ("improcedente", r"\bimprocedencia\b"),
    ("procedente", r"(?<!im)procedencia\b(?! em parte)"),
    ("homologacao_acordo", r"homologacao de (?:transacao|acordo)"),
    (
        "extinto_sem_merito",
        r"sem resolucao d[oe] merito|desistencia|abandono da causa|indeferimento da peticao inicial|"
        r"ausencia (?:das|de) condic|ausencia de pressupostos|perempcao|litispendencia|coisa julgada|"
        r"ausencia do autor a audiencia|inadmissibilidade do procedimento sumarissimo",
    ),
    ("parcialmente_provido", r"provimento em parte"),
    ("nao_provido", r"nao[- ]provimento"),
    ("provido", r"(?<!nao-)(?<!nao )\bprovimento\b(?! em parte)"),
    ("nao_conhecido", r"nao[- ]conhecimento"),
)


def of_movement(code: Column, name: Column) -> Column:
    """The outcome that a movement states; null if it is no judgement."""
    plain = unaccent(F.lower(F.coalesce(name, F.lit(""))))
    by_name = F.lit(None).cast("string")
    for outcome, pattern in reversed(NAMES):
        by_name = F.when(plain.rlike(pattern), outcome).otherwise(by_name)
    by_code = F.lit(None).cast("string")
    for number, outcome in CODES.items():
        by_code = F.when(code == number, outcome).otherwise(by_code)
    return F.when(~plain.rlike(IGNORED), F.coalesce(by_code, by_name))


def first_judgement(movements: Column) -> Column:
    """struct<resultado, evidencia, data> of the earliest judging movement (by text of dataHora, null first, given order kept)."""
    numbered = F.transform(movements, lambda m, i: F.struct(F.coalesce(m["dataHora"], F.lit("")).alias("at"), i.alias("i"), m["codigo"].alias("codigo"), m["nome"].alias("nome"), m["dataHora"].alias("dataHora")))
    judged = F.transform(F.array_sort(numbered), lambda m: F.struct(of_movement(m["codigo"], m["nome"]).alias("resultado"), F.trim(F.concat_ws(" ", m["codigo"].cast("string"), m["nome"])).alias("evidencia"), m["dataHora"].alias("data")))
    first = F.get(F.filter(judged, lambda m: m["resultado"].isNotNull()), F.lit(0))
    return F.coalesce(first, F.struct(F.lit(UNDETERMINED).alias("resultado"), F.lit("").alias("evidencia"), F.lit(None).cast("string").alias("data")))

"""Privacy rules: nothing secret, sensitive matters marked and left out by default, small groups suppressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.functions.text import unaccent

# Fixed values.
SECRET = r"segredo de justica|tramita(?:m|ndo)? (?:sob|em) sigilo|processo sigiloso|sob sigilo"
SENSITIVE = (
    r"(?U)\b(?:familia|alimentos|guarda|divorcio|uniao estavel|separacao|filiacao|paternidade|maternidade|adocao|"
    r"poder familiar|tutela de menor|infancia|juventude|crianca|adolescente|menor de idade|ato infracional|"
    r"estatuto da crianca|saude|tratamento medico|medicamento|internacao|hospital|plano de saude|doenca|hiv|aids|"
    r"deficiencia|interdicao|curatela|orientacao sexual|identidade de genero|homofobia|transfobia|religi\w+|culto|"
    r"violencia domestica|maria da penha|estupro|dignidade sexual|abuso sexual)\b"
)
SECRET_HEAD, SENSITIVE_HEAD = 3000, 5000


def secret(level: Column | None, text: Column | None = None) -> Column:
    found = F.coalesce(level != 0, F.lit(False)) if level is not None else F.lit(False)
    if text is not None:
        found |= F.coalesce(unaccent(F.lower(F.substring(text, 1, SECRET_HEAD))).rlike(SECRET), F.lit(False))
    return found


def sensitive(*descriptions: Column) -> Column:
    """Whether class, subjects or text name a sensitive matter; pass a text's first SENSITIVE_HEAD characters."""
    return unaccent(F.lower(F.concat_ws(" ", *descriptions))).rlike(SENSITIVE)


def publishable(df: DataFrame, n: str = "n", least: int = 10) -> DataFrame:
    return df.where(F.col(n) >= least)

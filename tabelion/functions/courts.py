"""The court dimension: 91 courts in six branches, and what case numbers say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States in the alphabetical order of their codes, and in that of the case number's TR field.
STATES = "ac al am ap ba ce df es go ma mg ms mt pa pb pe pi pr rj rn ro rr rs sc se sp to".split()
STATES_BY_TR = "ac al ap am ba ce df es go ma mt ms mg pa pb pr pe pi rj rn rs ro rr sc se sp to".split()
SUPERIOR, MILITARY = "stj tst tse stm".split(), "tjmmg tjmrs tjmsp".split()
FEDERAL, LABOUR = 6, 24
BRANCHES = ("superior", "federal", "estadual", "trabalho", "eleitoral", "militar")


def state_court(state: str) -> str:
    return "tjdft" if state == "df" else f"tj{state}"


def electoral_court(state: str) -> str:
    return "tre-dft" if state == "df" else f"tre-{state}"


COURTS: dict[str, str] = (
    dict.fromkeys(SUPERIOR, "superior") | {f"trf{i + 1}": "federal" for i in range(FEDERAL)} | {state_court(s): "estadual" for s in STATES}
    | {f"trt{i + 1}": "trabalho" for i in range(LABOUR)} | {electoral_court(s): "eleitoral" for s in STATES} | dict.fromkeys(MILITARY, "militar")
)


def dimension(spark: SparkSession) -> DataFrame:
    """tribunal, ramo, indice (of the case index), sigla_djen: 91 rows, small enough for every broadcast."""
    return spark.createDataFrame([(c, b, f"api_publica_{c}", c.upper()) for c, b in COURTS.items()], "tribunal string, ramo string, indice string, sigla_djen string")


def select(wanted: list[str] | None) -> list[str]:
    """Courts named by code or by branch, once each, in the order asked; all for none or "todos"."""
    if not wanted or "todos" in wanted:
        return list(COURTS)
    found: list[str] = []
    for name in (w.strip().lower() for w in wanted):
        hits = [c for c, b in COURTS.items() if name in (c, b)]
        if not hits:
            raise ValueError(f"no such court or branch: {name}")
        found += hits
    return list(dict.fromkeys(found))


def branch_of(court: Column) -> Column:
    """The branch of a court, "desconhecido" for others."""
    table = F.create_map(*(F.lit(x) for pair in COURTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(court, F.lit(""))), F.lit("desconhecido"))


# Case numbers: NNNNNNN-DD.YYYY.J.TR.OOOO with two check digits, modulo 97.

CASE_NUMBER = r"(?U)\b(\d{7})-?(\d{2})\.?(\d{4})\.?(\d)\.?(\d{2})\.?(\d{4})\b"


def valid_number(number: Column) -> Column:
    d = F.regexp_replace(number, "[^0-9]", "")
    rest = F.concat(F.substring(d, 1, 7), F.substring(d, 10, 11), F.lit("00"))
    # the remainder of 20 digits by parts, for a long holds 18
    part = (rest.substr(1, 10).try_cast("long") % 97) * (10**10 % 97) + rest.substr(11, 10).try_cast("long")
    return F.when(F.length(d) == 20, 98 - part % 97 == F.substring(d, 8, 2).try_cast("long")).otherwise(False)


def formatted_number(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^(\d{7})-?(\d{2})\.?(\d{4})\.?(\d)\.?(\d{2})\.?(\d{4})$", "$1-$2.$3.$4.$5.$6")


def case_numbers(text: Column) -> Column:
    """Valid case numbers in canonical form, once each, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CASE_NUMBER), F.lit(0)), formatted_number)
    return F.array_distinct(F.filter(found, valid_number))


def court_of_number(number: Column) -> Column:
    at = lambda group: F.regexp_extract(number, r"\d{7}-?\d{2}\.?\d{4}\.?(\d)\.?(\d{2})\.?\d{4}", group).try_cast("int")
    branch, tr = at(1), at(2)
    state = F.get(F.array(*map(F.lit, STATES_BY_TR)), tr - 1)
    return (
        F.when((branch == 8) & state.isNotNull(), F.when(state == "df", "tjdft").otherwise(F.concat(F.lit("tj"), state)))
        .when((branch == 6) & state.isNotNull(), F.when(state == "df", "tre-dft").otherwise(F.concat(F.lit("tre-"), state)))
        .when((branch == 4) & tr.between(1, FEDERAL), F.concat(F.lit("trf"), tr.cast("string")))
        .when((branch == 5) & tr.between(1, LABOUR), F.concat(F.lit("trt"), tr.cast("string")))
        .when((branch == 9) & state.isin("mg", "rs", "sp"), F.concat(F.lit("tjm"), state))
        .when(branch == 3, "stj").when(branch == 7, "stm")
    )

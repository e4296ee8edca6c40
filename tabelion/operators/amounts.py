"""Amounts and calculation parameters fixed by a ruling, as an Arrow batch function over pattern tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabelion.operators.decisions import folded, once_each
from tabelion.operators.rules import Stemmed

CALCULATION = (
    "valores array<struct<categoria:string,valor:double,trecho:string>>, honorarios_percentual double, honorarios_base string, repeticao string, "
    "juros_termos_iniciais array<string>, juros_taxa string, correcao_termos_iniciais array<string>, correcao_indice string, gratuidade boolean, valor_por_autor boolean"
)
# How far key words may be, spelled-out numbers, and the patterns in order.
WINDOW, AFTER_FEES = 90, 120
SPELLED = {"cinco": 5.0, "dez": 10.0, "doze": 12.0, "quinze": 15.0, "vinte": 20.0}
SCALES = {"mil": 1_000, "milhao": 1_000_000, "milhoes": 1_000_000}
MONEY = re.compile(r"r\$\s*(?P<whole>\d{1,3}(?:\.\d{3})+|\d+)(?:,(?P<cents>\d{1,2}))?(?:\s*(?P<scale>mil|milhoes|milhao)\b)?")
CATEGORIES = {
    "valor_causa": r"valor\s+(?:atualizado\s+)?da\s+causa", "honorarios": r"honorarios", "danos_morais": r"danos?\s+mora(?:l|is)|dano\s+extrapatrimonial",
    "danos_materiais": r"danos?\s+materia(?:l|is)|danos?\s+emergentes?", "lucros_cessantes": r"lucros?\s+cessantes?",
    "restituicao": r"restitui|repeticao|devolu|reembols|ressarc|indebito|cobrad[oa]s?\s+indevid",
    "debito_inexigivel": r"inexig\w+|inexistencia\s+d[eo]\s+debito|\bdebito\b", "multa": r"\bmulta\b|astreintes?",
    "pensao": r"\bpensao\b|pensionamento|alimentos", "custas": r"\bcustas\b",
}
FEES = re.compile(r"honorarios[^;]{0,200}?\b(?:(?P<number>\d{1,2}(?:,\d{1,2})?)\s*%|(?P<word>cinco|dez|doze|quinze|vinte)\s+por\s+cento)")
FEE_BASES = {
    "valor da condenação": r"(?:sobre\s+o\s+)?valor\s+(?:atualizado\s+)?da\s+condenacao", "valor da causa": r"(?:sobre\s+o\s+)?valor\s+(?:atualizado\s+)?da\s+causa",
    "proveito econômico": r"proveito\s+economico",
}
DOUBLED, RESTITUTION, SIMPLE = r"\bem\s+dobro\b|\bdobrad[oa]\b", r"restitui|repeticao|devolu", r"\bde\s+forma\s+simples\b|\bna\s+forma\s+simples\b|\bsimples(?:mente)?\b"
STARTS = {
    "citação": r"citacao",
    "evento danoso": r"evento\s+danoso|data\s+do\s+(?:fato|evento|ilicito)|(?:inscricao|negativacao)\s+indevida|data\s+da\s+(?:inscricao|negativacao)",
    "arbitramento": r"arbitramento|(?:data\s+d[ae]sta|prolacao\s+da)\s+(?:sentenca|decisao)|publicacao\s+d[ae]sta",
    "desembolso": r"(?:cada\s+)?desembolso|pagamento\s+indevido|(?:cada\s+)?cobranca|(?:cada\s+)?desconto",
    "vencimento": r"vencimento", "trânsito em julgado": r"transito\s+em\s+julgado", "ajuizamento": r"ajuizamento|propositura|distribuicao",
}
FROM = r"(?:desde|a\s+partir\s+d[aeo]s?|a\s+contar\s+d[aeo]s?|contad[oa]s?\s+d[aeo]s?)\s+(?:a\s+|o\s+|cada\s+)?"
CORRECTION = r"(?:correc\w+\s+monetaria|corrigid[oa]s?|atualizad[oa]s?\s+monetariamente)"
RATES = {
    "Selic": r"juros[^;]{0,120}?selic|selic[^;]{0,60}?juros", "1% ao mês": r"juros[^;]{0,80}?\b1\s*%\s*(?:\(um\s+por\s+cento\)\s*)?(?:ao|a\.)\s*m",
    "taxa legal (art. 406 CC)": r"juros[^;]{0,120}?(?:art\.?\s*406|taxa\s+legal)",
}
INDICES = {
    "IPCA-E": r"ipca-e\b", "IPCA": r"\bipca\b(?!-e)", "INPC": r"\binpc\b", "IGP-M": r"\bigp-?m\b", "Tabela Prática do TJSP": r"tabela\s+pratica",
    "Selic": r"correc\w+[^;]{0,120}?selic",
}
LEGAL_AID = r"gratuidade|justica\s+gratuita|assistencia\s+judiciaria|art\.?\s*98,?\s*(?:§|par\w*)\s*3|exigibilidade\s+suspensa|condicao\s+suspensiva"
PER_CLAIMANT = r"\bpara\s+cada\s+(?:um\s+d[oa]s\s+)?(?:autor|autora|requerente|parte)|\bpor\s+autor\b"


def _stemmed(table: dict[str, str], *stems: str) -> dict[str, Stemmed]:
    return {name: Stemmed(s, p) for (name, p), s in zip(table.items(), stems, strict=True)}


_any_start = "|".join(f"({p})" for p in STARTS.values())
_INTEREST_START = Stemmed("juros", rf"juros[^;]{{0,160}}?{FROM}(?:{_any_start})")
_CORRECTION_START = Stemmed("monetaria corrigid", rf"{CORRECTION}[^;]{{0,160}}?{FROM}(?:{_any_start})")
_CATEGORIES = _stemmed(
    CATEGORIES, "causa", "honorarios", "dano", "dano", "lucro", "restitui repeticao devolu reembols ressarc indebito cobrad", "inexig inexistencia debito", "multa astreinte", "pensao pensionamento alimentos", "custas",
)
_NAMES, _BREAK = list(CATEGORIES), re.compile(r";|r\$")
_FEE_BASES = _stemmed(FEE_BASES, "condenacao", "causa", "proveito")
_RATES, _INDICES = _stemmed(RATES, "selic", "juros", "juros"), _stemmed(INDICES, "ipca", "ipca", "inpc", "igp", "tabela", "selic")
_DOUBLED, _RESTITUTION, _SIMPLE = Stemmed("dobr", DOUBLED), Stemmed("restitui repeticao devolu", RESTITUTION), Stemmed("simples", SIMPLE)
_LEGAL_AID, _PER_CLAIMANT = Stemmed("gratui judiciaria 98 exigibilidade suspensiva", LEGAL_AID), Stemmed("cada autor", PER_CLAIMANT)


def first_of(table: dict[str, Stemmed], text: str) -> str | None:
    return next((name for name, p in table.items() if p.search(text)), None)


def amount(hit: re.Match) -> float:
    value = int(hit["whole"].replace(".", "")) + int(f"{hit['cents'] or '0'}0"[:2]) / 100
    return value * SCALES.get(hit["scale"], 1)


def category(text: str, start: int, end: int) -> str:
    """The category whose key word is nearest, not across a semicolon or another amount; of equally near ones the first listed."""
    before = _BREAK.split(text[max(0, start - WINDOW) : start])[-1]
    after = _BREAK.split(text[end : end + WINDOW])[0]
    gaps = []
    for rank, pattern in enumerate(_CATEGORIES.values()):
        if pattern.near(before):
            gaps += [(len(before) - hit.end(), rank) for hit in pattern.pattern.finditer(before)]
        gaps += [(hit.start(), rank) for hit in [pattern.search(after)] if hit]
    return _NAMES[min(gaps)[1]] if gaps else "outros"


def starts(pattern: Stemmed, text: str) -> list[str]:
    names = list(STARTS)
    return list(dict.fromkeys(names[hit.lastindex - 1] for hit in pattern.pattern.finditer(text))) if pattern.near(text) else []


def calculate(ruling: str) -> dict:
    text = folded(ruling)
    fees = FEES.search(text)
    return {
        "valores": [{"categoria": category(text, *hit.span()), "valor": float(amount(hit)), "trecho": hit[0]} for hit in MONEY.finditer(text)],
        "honorarios_percentual": None if not fees else float(fees["number"].replace(",", ".")) if fees["number"] else SPELLED[fees["word"]],
        "honorarios_base": first_of(_FEE_BASES, text[fees.end() : fees.end() + AFTER_FEES]) if fees else None,
        "repeticao": "em dobro" if _DOUBLED.search(text) else "simples" if _SIMPLE.search(text) and _RESTITUTION.search(text) else None,
        "juros_termos_iniciais": starts(_INTEREST_START, text), "juros_taxa": first_of(_RATES, text),
        "correcao_termos_iniciais": starts(_CORRECTION_START, text), "correcao_indice": first_of(_INDICES, text),
        "gratuidade": bool(_LEGAL_AID.search(text)), "valor_por_autor": bool(_PER_CLAIMANT.search(text)),
    }


def calculation(ruling: Column) -> Column:
    """struct of CALCULATION for a column of rulings; null rulings are empty."""

    @F.pandas_udf(CALCULATION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(once_each(calculate, batch), columns=list(calculate("")))

    return run.asNondeterministic()(ruling)


def first_amount(calculation: Column, name: str) -> Column:
    """The first amount of a category, or null."""
    return F.get(F.filter(calculation["valores"], lambda v: v["categoria"] == name), F.lit(0))["valor"]

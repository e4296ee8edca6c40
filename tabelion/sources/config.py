"""Job configuration in TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path


@dataclass
class CaseQuery:
    assuntos_codigos: list[int] = field(default_factory=list)
    assuntos_nomes: list[str] = field(default_factory=list)
    classes_codigos: list[int] = field(default_factory=list)
    graus: list[str] = field(default_factory=list)
    ajuizamento_desde: date | None = None
    ajuizamento_ate: date | None = None
    limite_por_tribunal: int | None = None
    tamanho_pagina: int = 500


@dataclass
class NoticeQuery:
    texto: str | None = None
    tipos_documento: list[str] = field(default_factory=lambda: ["Sentença", "Acórdão"])
    data_inicio: date | None = None
    data_fim: date | None = None
    limite_por_tribunal: int | None = None
    itens_por_pagina: int = 100


@dataclass
class Job:
    nome: str
    descricao: str = ""
    tribunais: list[str] = field(default_factory=lambda: ["todos"])
    incluir_sensiveis: bool = False
    datajud: CaseQuery = field(default_factory=CaseQuery)
    djen: NoticeQuery = field(default_factory=NoticeQuery)


def _dated(given: dict, *names: str) -> dict:
    return given | {n: date.fromisoformat(str(given[n])) for n in names if given.get(n) is not None}


def load(path: str | Path) -> Job:
    given = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if "nome" not in given:
        raise ValueError(f"{path}: a job needs a field 'nome'")
    cases = CaseQuery(**_dated(given.pop("datajud", {}), "ajuizamento_desde", "ajuizamento_ate"))
    notices = NoticeQuery(**_dated(given.pop("djen", {}), "data_inicio", "data_fim"))
    return Job(**given, datajud=cases, djen=notices)

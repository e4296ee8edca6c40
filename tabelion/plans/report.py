"""The published report: measures as CSV, metadata, dictionary and one HTML page. Only aggregates reach the driver.

Unlike the plain measures, published tables of counts are suppressed too: rows below `least` are left out by default.
"""

from __future__ import annotations

import contextlib
import csv
import html
import json
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.functions.stats import LEAST_PUBLISHED
from tabelion.operators import citations, consolidate, decisions, measures
from tabelion.sources.corpus import Corpus

LICENCE = "CC BY 4.0"
LABELS = {
    "distribuicao_primeira": "Resultados em primeira instância", "distribuicao_segunda": "Resultados em segunda instância", "taxa_nacional": "Taxas nacionais",
    "taxas_ramo": "Acolhimento do pedido por ramo", "taxas_tribunal": "Acolhimento do pedido por tribunal", "taxas_ano": "Acolhimento do pedido por ano",
    "taxas_grau": "Acolhimento do pedido por grau", "taxas_assunto": "Acolhimento do pedido por assunto", "reforma_cruzamento": "Sentença e recurso",
    "reforma_resultado_final": "Sentença e resultado final", "motivos_extincao": "Motivos de extinção", "danos_morais_tribunal": "Danos morais por tribunal",
    "parametros_calculo": "Parâmetros de cálculo", "duracao_tribunal": "Duração por tribunal", "citacoes": "Normas citadas",
    "vocabulario_acolhido": "Vocabulário de decisões acolhidas", "vocabulario_rejeitado": "Vocabulário de decisões rejeitadas",
}
MEANINGS = {
    "n, total": "quantidade de registros do grupo", "proporcao": "n sobre o total, antes da supressão", "merito": "procedentes, parcialmente procedentes e improcedentes",
    "procedencia, acolhimento, provimento": "taxas sobre merito ou recursos", "*_ic_inf, *_ic_sup": "intervalo de Wilson a 95%", "mediana, q1, q3": "mediana e quartis",
    "em_acolhidos, em_rejeitados": "proporção dos documentos de cada lado que citam a norma", "z": "log-odds com distribuição a priori de Dirichlet; positivo = acolhido",
}


@contextlib.contextmanager
def tables(corpus: Corpus, with_sensitive: bool = False, least: int = LEAST_PUBLISHED, suppress: bool = True) -> Iterator[tuple[dict[str, DataFrame], dict[str, DataFrame]]]:
    """(tables to publish, one-row indicators) over the corpus; units are computed once and kept in memory or on disk meanwhile."""
    cases, docs = corpus.cases(with_sensitive), corpus.documents(with_sensitive)
    if cases is None or docs is None:
        yield {}, {}
        return
    units = consolidate.consolidate(cases, docs).persist()
    first, second = units.where("instancia = '1'"), units.where("instancia = '2'")
    pairs = measures.appealed(units)
    parts = docs.select("id", "resultado", "texto").withColumn("s", decisions.sections(F.col("texto")))
    grounds = parts.select("resultado", F.concat_ws("\n", "s.relatorio", "s.fundamentacao").alias("t"))
    granted, denied = measures.vocabulary_tables(measures.vocabulary(grounds, "t"))
    counts = {
        "distribuicao_primeira": measures.distribution(first), "distribuicao_segunda": measures.distribution(second), "motivos_extincao": measures.reasons(first),
        "reforma_cruzamento": measures.cross_table(pairs, "sentenca", "recurso"), "reforma_resultado_final": measures.cross_table(pairs, "sentenca", "final"),
    }
    rated = {f"taxas_{g}": measures.rates(units, g, least) for g in ("ramo", "tribunal", "grau", "assunto")}
    found = {k: v.where(F.col("n") >= least) if suppress else v for k, v in counts.items()} | rated | {
        "taxa_nacional": measures.national_rates(units, least), "taxas_ano": measures.rates(units, "ano", least).orderBy("grupo"),
        "danos_morais_tribunal": measures.award_amounts(first, "danos_morais", least=least), "parametros_calculo": measures.calculation_parameters(first, least),
        "duracao_tribunal": measures.durations(cases, "tribunal", least),
        "citacoes": measures.shares_by_side(docs.select("id", "resultado", citations.cited(F.col("texto"))["referencia"].alias("r")), "r", least=least),
        "vocabulario_acolhido": granted, "vocabulario_rejeitado": denied,
    }
    single = {"qualidade_da_classificacao": measures.quality(units), "reforma": measures.reversal_rate(pairs), "provimento_por_recurso": measures.reversals_by_appeal(second, least)}
    try:
        yield found, single
    finally:
        units.unpersist()


def write_csv(path: Path, rows: list[dict]) -> None:
    """No file for no rows."""
    if rows:
        with path.open("w", newline="", encoding="utf-8") as out:
            writer = csv.DictWriter(out, list(rows[0]))
            writer.writeheader()
            writer.writerows(rows)


def number(value: object) -> str:
    """1.234 or 12,3% style for Portuguese readers; a dash for nothing."""
    if value is None or value != value:
        return "—"
    if isinstance(value, float):
        return (f"{value:.1%}" if abs(value) <= 1 else f"{value:,.1f}").translate(str.maketrans(",.", ".,"))
    return f"{value:,}".replace(",", ".") if isinstance(value, int) else str(value)


def bars(rows: list[dict], name: str, value: str, low: str | None = None, high: str | None = None) -> str:
    """One horizontal bar a row, with an interval line where bounds are given."""
    rows = [r for r in rows if r.get(value) is not None][:30]
    top = max((r.get(high) or r[value] for r in rows), default=0) or 1
    out = [f'<svg viewBox="0 0 640 {24 * len(rows) + 8}" role="img">']
    for i, r in enumerate(rows):
        y, x = 24 * i + 4, lambda v: 200 + 380 * float(v) / float(top)
        out.append(f'<text x="192" y="{y + 14}" text-anchor="end">{html.escape(str(r[name]))[:32]}</text><rect x="200" y="{y}" width="{x(r[value]) - 200:.1f}" height="16"/>')
        if low and r.get(low) is not None:
            out.append(f'<line x1="{x(r[low]):.1f}" x2="{x(r[high]):.1f}" y1="{y + 8}" y2="{y + 8}"/>')
        out.append(f'<text x="{x(r.get(high) or r[value]) + 4:.1f}" y="{y + 14}">{number(r[value])}</text>')
    return "".join([*out, "</svg>"])


def ranges(rows: list[dict], name: str, low: str, middle: str, high: str) -> str:
    """One horizontal line a row from the lower to the upper quartile, with a mark at the median."""
    rows = [r for r in rows if r.get(middle) is not None][:30]
    top = float(max((r[high] for r in rows), default=0) or 1)
    out = [f'<svg viewBox="0 0 640 {24 * len(rows) + 8}" role="img">']
    for i, r in enumerate(rows):
        y, at = 24 * i + 12, [200 + 380 * float(r[k]) / top for k in (low, middle, high)]
        out.append(f'<text x="192" y="{y + 6}" text-anchor="end">{html.escape(str(r[name]))[:32]}</text><line x1="{at[0]:.1f}" x2="{at[2]:.1f}" y1="{y}" y2="{y}"/><circle cx="{at[1]:.1f}" cy="{y}" r="5"/><text x="{at[2] + 8:.1f}" y="{y + 6}">{number(float(r[middle]))}</text>')
    return "".join([*out, "</svg>"])


def stacked(rows: list[dict], name: str, part: str, value: str) -> str:
    """One bar of shares a name, cut by part; the legend's tones are the parts' in order of size."""
    total, sizes = Counter(), Counter()
    for r in rows:
        total[r[name]] += r[value]
        sizes[r[part]] += r[value]
    tone = {p: 1 - 0.8 * i / max(1, len(sizes)) for i, (p, _) in enumerate(sizes.most_common())}
    out = [f'<svg viewBox="0 0 640 {24 * len(total) + 20 * len(tone) + 12}" role="img">']
    for i, (key, n) in enumerate(total.most_common()):
        x = 200.0
        out.append(f'<text x="192" y="{24 * i + 18}" text-anchor="end">{html.escape(str(key))[:32]}</text>')
        for r in (r for p in tone for r in rows if r[name] == key and r[part] == p):
            width = 380 * r[value] / n
            out.append(f'<rect x="{x:.1f}" y="{24 * i + 4}" width="{width:.1f}" height="16" opacity="{tone[r[part]]:.2f}"><title>{html.escape(str(r[part]))}: {number(r[value])}</title></rect>')
            x += width
    for j, (p, opacity) in enumerate(tone.items()):
        y = 24 * len(total) + 20 * j + 8
        out.append(f'<rect x="200" y="{y}" width="12" height="12" opacity="{opacity:.2f}"/><text x="218" y="{y + 11}">{html.escape(str(p))}</text>')
    return "".join([*out, "</svg>"])


def pairs_of_bars(rows: list[dict], name: str, left: str, right: str) -> str:
    """Two bars a row that grow from the middle: shares among granting documents to the right, among denying ones to the left."""
    rows = [r for r in rows if r.get(left) is not None and r.get(right) is not None][:30]
    top = max((max(r[left], r[right]) for r in rows), default=0) or 1
    out = [f'<svg viewBox="0 0 640 {24 * len(rows) + 8}" role="img">']
    for i, r in enumerate(rows):
        y, a, b = 24 * i + 4, 180 * r[left] / top, 180 * r[right] / top
        out.append(f'<text x="152" y="{y + 14}" text-anchor="end">{html.escape(str(r[name]))[:24]}</text><rect x="{360 - b:.1f}" y="{y}" width="{b:.1f}" height="16" opacity="0.5"/><rect x="360" y="{y}" width="{a:.1f}" height="16"/><text x="{364 + a:.1f}" y="{y + 14}">{number(float(r[left]))} / {number(float(r[right]))}</text>')
    return "".join([*out, "</svg>"])


def line(rows: list[dict], name: str, value: str) -> str:
    """Values in the order of names, joined by a line."""
    points = [(str(r[name]), float(r[value])) for r in rows if r.get(value) is not None]
    step, top = 560 / max(1, len(points) - 1), max((v for _, v in points), default=0) or 1
    at = [(40 + step * i, 150 - 130 * v / top) for i, (_, v) in enumerate(points)]
    marks = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4"><title>{html.escape(n)}: {number(v)}</title></circle><text x="{x:.1f}" y="172" text-anchor="middle">{html.escape(n)[:6]}</text>' for (x, y), (n, v) in zip(at, points, strict=True))
    return f'<svg viewBox="0 0 640 180" role="img"><polyline fill="none" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in at)}"/>{marks}</svg>'


def html_table(rows: list[dict]) -> str:
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(number(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def chart(name: str, rows: list[dict]) -> str:
    if name == "taxas_ano":
        return line(rows, "grupo", "acolhimento")
    if name.startswith("taxas_"):
        return bars(rows, "grupo", "acolhimento", "acolhimento_ic_inf", "acolhimento_ic_sup")
    if name.startswith("reforma_"):
        return stacked(rows, "sentenca", next(k for k in rows[0] if k not in ("sentenca", "n")), "n")
    if name == "citacoes":
        return pairs_of_bars(rows, "citacao", "em_acolhidos", "em_rejeitados")
    if name in ("danos_morais_tribunal", "duracao_tribunal"):
        return ranges(rows, "grupo", *((f"{k}_dias" if name.startswith("duracao") else k) for k in ("q1", "mediana", "q3")))
    label = next(k for k, v in rows[0].items() if isinstance(v, str))
    value = next((k for k in ("n", "agregada", "z") if k in rows[0]), None)
    return bars([r | {value: abs(r[value])} for r in rows if r[value] is not None], label, value) if value else ""


def page(found: dict[str, list[dict]], title: str, description: str, made: str) -> str:
    style = (
        ":root{color-scheme:light dark;--ink:#222;--bar:#3a6ea5;--back:#fff}@media (prefers-color-scheme: dark){:root{--ink:#ddd;--bar:#7fb0e0;--back:#181818}}"
        "body{font:16px/1.5 sans-serif;color:var(--ink);background:var(--back);max-width:60rem;margin:auto;padding:1rem}svg{width:100%;font-size:12px}text{fill:var(--ink)}rect,circle{fill:var(--bar)}"
        "line,polyline{stroke:var(--ink)}table{border-collapse:collapse}td,th{padding:.2rem .6rem;text-align:left}"
    )
    parts = [f"<section><h2>{html.escape(LABELS[k])}</h2>{chart(k, rows)}<details><summary>Ver a tabela</summary>{html_table(rows)}</details></section>" for k, rows in found.items() if rows]
    body = "".join(parts) or "<p>O corpus ainda está vazio.</p>"
    return f'<!DOCTYPE html><html lang="pt-BR"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><p>{html.escape(description)}</p>{body}<footer>{made} · {LICENCE}</footer></body></html>'


def generate(corpus: Corpus, out: str | Path, title: str = "Relatório", description: str = "", with_sensitive: bool = False, least: int = LEAST_PUBLISHED, suppress: bool = True) -> Path:
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    with tables(corpus, with_sensitive, least, suppress) as (published, indicators):
        # grouped tables have a row a group at most; what is collected here doesn't grow with the corpus
        found = {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in published.items()}
        single = {k: (r.asDict(recursive=True) if (r := df.first()) else None) for k, df in indicators.items()}
    for name, rows in found.items():
        write_csv(out / f"{name}.csv", rows)
    made = datetime.now(UTC).isoformat(timespec="seconds")
    meta = {
        "titulo": title, "descricao": description, "gerado_em": made, "minimo_publicavel": least, "inclui_materias_sensiveis": with_sensitive, "resumo": corpus.summary(),
        "qualidade_da_classificacao": single.get("qualidade_da_classificacao"), "taxa_de_reforma": (single.get("reforma") or {}).get("taxa_reforma"), "provimento_por_recurso": single.get("provimento_por_recurso"), "licenca": LICENCE,
    }
    (out / "metadados.json").write_text(json.dumps(meta, ensure_ascii=False, indent=2), encoding="utf-8")
    rows = "\n".join(f"| {k} | {v} |" for k, v in MEANINGS.items())
    (out / "DICIONARIO.md").write_text(f"# Dicionário de dados\n\nGrupos com menos de {least} casos não são publicados.\n\n| Coluna | Significado |\n|---|---|\n{rows}\n", encoding="utf-8")
    target = out / "relatorio.html"
    target.write_text(page(found, title, description, made), encoding="utf-8")
    return target

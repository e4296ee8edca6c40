"""The decision rules as data: patterns over lower-case text without accents, in order of priority."""

from __future__ import annotations

import re
from typing import NamedTuple

ACTION, APPEAL, MOTION = "acao", "recurso", "embargos_declaracao"


class Rule(NamedTuple):
    outcome: str
    kind: str
    pattern: str
    strong: bool = True
    reason: str | None = None
    target: str | None = None
    #: Parts of words of which each match holds at least one.
    stems: str = ""


class Stemmed:
    """A pattern, looked for only in texts with a stem of which each of its matches holds at least one; these are found much faster."""

    def __init__(self, stems: str, pattern: str) -> None:
        self.stems, self.pattern = stems.split(), re.compile(pattern)

    def near(self, text: str) -> bool:
        return any([s in text for s in self.stems])

    def search(self, text: str) -> re.Match | None:
        return self.pattern.search(text) if self.near(text) else None


def lowered(text: str) -> str:
    """text as stems of patterns that ignore case are looked for: these also take the long s, and i with and without its dot."""
    return text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s").lower()


# Fixed values from here on: outcomes, the 41 rules in order of priority, objects, reasons and headings.
FULL, PART, DENIED = "procedente", "parcialmente_procedente", "improcedente"
DISMISSED, SETTLED = "extinto_sem_merito", "homologacao_acordo"
WON, PARTLY_WON, LOST, NOT_HEARD = "provido", "parcialmente_provido", "nao_provido", "nao_conhecido"
OPEN = "indeterminado"

RULES = (
    Rule(PART, ACTION, r"\b(?:parcialmente\s+procedentes?|procedentes?,?\s+(?:em\s+parte|parcialmente)|em\s+parte,?\s+procedentes?|parcial\s+procedencia|procedencia\s+parcial)\b", stems="proceden"),
    Rule(PART, ACTION, r"\bacolh\w*(?:-(?:o|os|a|as|se))?\s+(?:em\s+parte|parcialmente)\b(?!\s+os\s+embargos)", stems="acolh"),
    Rule(PART, ACTION, r"\bacolh\w*(?:-(?:os|se))?\s+(?:em\s+parte|parcialmente)\s+(?:os\s+)?embargos\s+(?:a\s+execucao|do\s+devedor|do\s+executado|de\s+terceiros?)\b", stems="embargos"),
    Rule(FULL, ACTION, r"\bacolh\w*(?:-(?:os|se))?\s+(?:os\s+)?embargos\s+(?:a\s+execucao|do\s+devedor|do\s+executado|de\s+terceiros?)\b", stems="embargos"),
    Rule(DENIED, ACTION, r"\b(?:rejeit|desacolh)\w*(?:-(?:os|se))?\s+(?:os\s+)?embargos\s+(?:a\s+execucao|do\s+devedor|do\s+executado|de\s+terceiros?)\b", stems="embargos"),
    Rule(PART, ACTION, r"\bacolh\w*(?:-(?:os|se))?\s+(?:em\s+parte|parcialmente)\s+(?:os\s+)?embargos\s+(?:monitorios|a\s+(?:acao\s+)?monitoria)\b", stems="monitori"),
    Rule(DENIED, ACTION, r"\bacolh\w*(?:-(?:os|se))?\s+(?:os\s+)?embargos\s+(?:monitorios|a\s+(?:acao\s+)?monitoria)\b", stems="monitori"),
    Rule(FULL, ACTION, r"\b(?:rejeit|desacolh)\w*(?:-(?:os|se))?\s+(?:os\s+)?embargos\s+(?:monitorios|a\s+(?:acao\s+)?monitoria)\b", stems="monitori"),
    Rule(PART, ACTION, r"\bconced\w*(?:-se)?\s+(?:em\s+parte|parcialmente)\s+a\s+seguranca|\bseguranca\s+(?:parcialmente\s+concedida|concedida\s+em\s+parte)", stems="seguranca"),
    Rule(FULL, ACTION, r"\bconced\w*(?:-se)?\s+(?:a\s+)?seguranca|\bseguranca\s+concedida", stems="seguranca"),
    Rule(DENIED, ACTION, r"\bdeneg\w*(?:-se)?\s+(?:a\s+)?seguranca|\bseguranca\s+denegada", stems="seguranca"),
    Rule(DENIED, ACTION, r"\babsolv\w*(?:-(?:o|a|os|as|se))?\b", stems="absolv"),
    Rule(FULL, ACTION, r"\bcondeno-?(?:o|a|os|as)?\s+(?:o\s+|a\s+)?(?:reu|re|acusad[oa]s?|denunciad[oa]s?)?\s*(?:como\s+)?incurs[oa]s?\b", stems="incurs"),
    Rule(DENIED, ACTION, r"(?<!nao )(?<!deixo de )(?<!deixa de )(?<!afasto a )\b(?:pronunci|reconhec|declar|acolh|decret)\w*(?:-se)?\s+(?:de\s+oficio\s+)?(?:a\s+)?(?:ocorrencia\s+da\s+)?(?:prejudicial\s+(?:de\s+merito\s+)?(?:de\s+|da\s+)?)?prescricao", reason="prescrição", stems="prescricao"),
    Rule(DENIED, ACTION, r"(?<!nao )(?<!deixo de )(?<!deixa de )(?<!afasto a )\b(?:pronunci|reconhec|declar|acolh|decret)\w*(?:-se)?\s+(?:de\s+oficio\s+)?(?:a\s+)?(?:ocorrencia\s+da\s+)?decadencia", reason="decadência", stems="decadencia"),
    Rule(DENIED, ACTION, r"\bart(?:igo)?s?\.?\s*487,?\s*(?:inciso\s+)?ii\b", reason="art. 487, II", stems="487"),
    Rule(FULL, ACTION, r"\breconhecimento\s+(?:juridico\s+)?(?:da\s+procedencia\s+)?do\s+pedido|\bart(?:igo)?s?\.?\s*487,?\s*(?:inciso\s+)?iii,?\s*(?:alinea\s+)?\W?a\b", reason="reconhecimento do pedido", stems="reconhecimento 487"),
    Rule(DENIED, ACTION, r"\brenuncia\s+(?:a\s+pretensao|ao\s+direito)|\bart(?:igo)?s?\.?\s*487,?\s*(?:inciso\s+)?iii,?\s*(?:alinea\s+)?\W?c\b", reason="renúncia à pretensão", stems="renuncia 487"),
    Rule(SETTLED, ACTION, r"\bhomolog\w*(?:-se)?\b[^.;]{0,120}?\b(?:acordo|transacao|composicao|conciliacao|autocomposicao)\b|\bart(?:igo)?s?\.?\s*487,?\s*(?:inciso\s+)?iii,?\s*(?:alinea\s+)?\W?b\b", stems="homolog 487"),
    Rule(DISMISSED, ACTION, r"\bhomolog\w*(?:-se)?\b[^.;]{0,60}?\bdesistencia\b|\bdesistencia\s+da\s+acao\b", reason="desistência (art. 485, VIII)", stems="desistencia"),
    Rule(DISMISSED, ACTION, r"\bsem\s+(?:resolucao|julgamento|exame|apreciacao|analise)\s+d[oe]\s+merito", stems="merito"),
    Rule(DISMISSED, ACTION, r"\bart(?:igo)?s?\.?\s*485\b", stems="485"),
    Rule(DISMISSED, ACTION, r"\bindefiro\s+(?:a\s+)?(?:peticao\s+)?inicial|\bindeferimento\s+da\s+(?:peticao\s+)?inicial", reason="indeferimento da inicial (art. 485, I)", stems="inicial"),
    Rule(DISMISSED, ACTION, r"\b(?:julgo|declaro|decreto|julga-se)\s+extint[oa]\s+(?:o\s+)?(?:processo|feito|acao)\b(?![^.;]{0,80}\bcom\s+(?:resolucao|julgamento|exame)\b)", strong=False, stems="extint"),
    Rule(DENIED, ACTION, r"\bimprocedentes?\b|\bimprocedencia\s+d[oa]s?\s+(?:pedidos?|acao|demanda)\b", stems="improceden"),
    Rule(DENIED, ACTION, r"\b(?:rejeit|desacolh)\w*(?:-(?:o|os|se))?\s+(?:integralmente\s+|totalmente\s+)?(?:o|os)\s+pedidos?\b|\bnao\s+acolh\w*\s+(?:o|os)\s+pedidos?\b", stems="pedido"),
    Rule(FULL, ACTION, r"(?<![\w-])procedentes?\b|\bprocedencia\s+d[oa]s?\s+(?:pedidos?|acao|demanda)\b", stems="proceden"),
    Rule(FULL, ACTION, r"\bacolh\w*(?:-(?:o|os|se))?\s+(?:integralmente\s+|totalmente\s+)?(?:o|os)\s+pedidos?\b", stems="pedido"),
    Rule(FULL, ACTION, r"\bcondeno\s+(?:o|a|os|as)\s+(?:re[ua]?s?|requerid[oa]s?|demandad[oa]s?)\b", strong=False, stems="condeno"),
    Rule(PARTLY_WON, APPEAL, r"\bacolh\w*(?:-(?:os|se))?\s+(?:em\s+parte|parcialmente)\s+(?:os\s+)?(?:presentes\s+)?embargos\b", target=MOTION, stems="embargos"),
    Rule(WON, APPEAL, r"\bacolh\w*(?:-(?:os|se))?\s+(?:os\s+)?(?:presentes\s+)?embargos\b(?!\s+(?:a\s+execucao|do\s+devedor|do\s+executado|de\s+terceiro|monitorios|a\s+monitoria))", target=MOTION, stems="embargos"),
    Rule(LOST, APPEAL, r"\b(?:rejeit|desacolh)\w*(?:-(?:os|se))?\s+(?:os\s+)?(?:presentes\s+)?embargos\b(?!\s+(?:a\s+execucao|do\s+devedor|do\s+executado|de\s+terceiro|monitorios|a\s+monitoria))", target=MOTION, stems="embargos"),
    Rule(PARTLY_WON, APPEAL, r"\bd(?:ou|a|ar|ao|eram|emos|ando|e|eu)(?:-(?:se|lhe|lhes))?\s+(?:parcial\s+provimento|provimento\s+parcial|provimento\s+em\s+parte)\b|\bparcialmente\s+provid[oa]s?\b|\bprovid[oa]s?,?\s+(?:em\s+parte|parcialmente)\b|\bprovimento\s+parcial\b|\bparcial\s+provimento\b", stems="provi"),
    Rule(LOST, APPEAL, r"\bneg(?:o|a|ar|am|aram|amos|ando|ue|ou)(?:-(?:se|lhe|lhes))?\s+(?:integral\s+)?provimento\b|\bnao\s+provid[oa]s?\b|\b(?:des|im)provid[oa]s?\b|\b(?:des|im)provimento\b", stems="provi"),
    Rule(WON, APPEAL, r"\bd(?:ou|a|ar|ao|eram|emos|ando|e|eu)(?:-(?:se|lhe|lhes))?\s+(?:integral\s+|total\s+)?provimento\b|\bprovid[oa]s?\b", stems="provi"),
    Rule(WON, APPEAL, r"\b(?:anul|cass|desconstitu)\w*(?:-se)?\s+(?:a\s+|na\s+integra\s+a\s+)?(?:r\.\s*|douta\s+|respeitavel\s+)?sentenca\b", reason="anulação da sentença", stems="sentenca"),
    Rule(NOT_HEARD, APPEAL, r"\bnao\s+(?:se\s+)?conhe(?:co|ce|cer|ceram|cemos|cido|cida|ceu)\b(?!\s+(?:de\s+)?(?:parte|em\s+parte|parcialmente))", stems="conhe"),
    Rule(NOT_HEARD, APPEAL, r"\b(?:julg\w*\s+)?prejudicad[oa]s?\s+(?:o\s+|os\s+)?(?:recursos?|apelo|apelac\w+)|\b(?:recursos?|apelo|apelacao)\s+prejudicad[oa]s?\b", reason="recurso prejudicado", stems="prejudicad"),
    Rule(PARTLY_WON, APPEAL, r"\breform\w*(?:-se)?\s+(?:em\s+parte|parcialmente)\s+(?:a\s+|na\s+integra\s+a\s+)?(?:r\.\s*|douta\s+|respeitavel\s+)?sentenca|\bsentenca\s+(?:parcialmente\s+reformada|reformada\s+em\s+parte)", strong=False, stems="sentenca"),
    Rule(WON, APPEAL, r"\breform\w*(?:-se)?\s+(?:integralmente\s+)?(?:a\s+|na\s+integra\s+a\s+)?(?:r\.\s*|douta\s+|respeitavel\s+)?sentenca|\bsentenca\s+reformada", strong=False, stems="sentenca"),
    Rule(LOST, APPEAL, r"\b(?:mantid[oa]|mantenho|mantem-se|mantiveram|manter|confirm\w*)\s+(?:-se\s+)?(?:a\s+|na\s+integra\s+a\s+)?(?:r\.\s*|douta\s+|respeitavel\s+)?sentenca|\bsentenca\s+(?:mantida|confirmada)", strong=False, stems="sentenca"),
)

TARGETS = {
    "reconvencao": r"reconven", "pedido_contraposto": r"pedido\s+contraposto|contrapedido",
    MOTION: r"embargos\s+de\s+declaracao|declaratorios|aclaratorios",
    "denunciacao": r"denuncia(?:cao|d)|lide\s+secundaria|chamamento\s+ao\s+processo", "impugnacao": r"\bimpugnac",
    "incidente": r"\bincidente\b|\bexcecao\s+de\b|\bhabilitacao\b",
}
MAIN_TARGET = r"\b(?:pedidos?|acao|demanda|pretens\w+|inicial|lide)\b"
PARTLY_HEARD = r"\bnao\s+conhe\w*\s+(?:de\s+)?(?:parte|em\s+parte)|\bconhe\w*\s+(?:em\s+parte|parcialmente)|\bna\s+parte\s+conhecida\b"
ARTICLE_485 = {
    "i": "indeferimento da inicial", "ii": "paralisação por negligência das partes", "iii": "abandono da causa",
    "iv": "falta de pressuposto processual", "v": "perempção, litispendência ou coisa julgada", "vi": "ilegitimidade ou falta de interesse",
    "vii": "convenção de arbitragem", "viii": "desistência", "ix": "ação intransmissível", "x": "outros casos legais",
}
ITEM_485 = r"485,?\s*(?:caput\s*,?\s*)?(?:inciso\s+)?\b([ivx]+)\b"
CAUSES_485 = (
    ("vi", r"ilegitimidade|interesse\s+(?:de\s+agir|processual)|carencia\s+(?:de|da)\s+acao"), ("v", r"litispendencia|coisa\s+julgada|perempcao"),
    ("iii", r"abandono"), ("viii", r"desistencia"), ("vii", r"arbitragem|compromisso\s+arbitral"),
    ("iv", r"pressupostos?\s+(?:processua|de\s+constituicao)"), ("i", r"inepcia|indefir\w*\s+(?:a\s+)?(?:peticao\s+)?inicial"),
)
UNANIMOUS = r"\bpor\s+unanimidade\b|\bv\.\s*u\.|\bvotacao\s+unanime\b|\bunanimemente\b"
MAJORITY = r"\bpor\s+maioria\b|\bvencid[oa]s?\s+(?:o|a|os|as)\s+\w+|\bmaioria\s+de\s+votos\b"
PANEL_HEAD = r"\bacord(?:am|ao)\b|\bvoto\s+(?:n|do\s+relator|condutor)|\brelator(?:a)?\b|\bturma\s+recursal\b|\bcamara\s+(?:de\s+direito|civel|criminal)|\bapelacao\s+civel\b"
SINGLE_HEAD, SENTENCE_HEAD, MOTION_HEAD = r"\bdecisao\s+monocratica\b|\bmonocraticamente\b|\bart\.?\s*932\b", r"\bsentenca\b", r"\bembargos\s+de\s+declaracao\b"

REPORT_END = r"(?im)^\s*(?:é\s+o\s+(?:breve\s+|sucinto\s+)?relat[óo]rio|relatei|relatados?|(?:fundamento\s+e\s+)?decido|fundamenta[çc][ãa]o|fundamento|dispensado\s+o\s+relat[óo]rio)\b[^\n]*$"
CONCLUSION = (
    r"(?im)\b(?:ante\s+(?:todo\s+)?o\s+exposto|diante\s+(?:de\s+todo\s+)?(?:do\s+)?exposto|pelo\s+exposto|por\s+todo\s+o\s+exposto|do\s+exposto|"
    r"em\s+face\s+do\s+exposto|isto\s+posto|isso\s+posto|posto\s+isso|face\s+ao\s+exposto|diante\s+do\s+quanto\s+exposto|ante\s+o\s+quanto\s+exposto)\b|"
    r"^\s*(?:III?\s*[-–.]\s*)?dispositivo\s*$"
)
DISSENT = r"(?im)^\s*(?:declara[çc][ãa]o\s+de\s+voto|voto\s+(?:vencido|divergente)|voto\s+n[º°o.]*\s*\d+\s*[-–(]?\s*vencido)\b"
PANEL = (
    r"(?is)\bacordam\b[^.]{0,500}?\b(?:provimento|provid[oa]|conhec\w*|prejudicad[oa]|embargos|anul\w*|cass\w*|seguran[çc]a|ordem|"
    r"procedente|improcedente)\b[^.]*\."
)
JUDGING = r"(?i)\b(?:julgo|julgamos|acordam|homologo|extingo|dou|nego|negam|d[ãa]o)\b"

COMPILED = tuple(re.compile(r.pattern) for r in RULES)
STEMS = tuple(dict.fromkeys(s for r in RULES for s in r.stems.split()))
NEEDED = tuple(frozenset(r.stems.split()) for r in RULES)

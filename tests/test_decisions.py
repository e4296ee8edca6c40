"""Rulings and whole decisions."""

import pytest
from pyspark.sql import functions as F

from tabelion.operators import amounts, citations, decisions

# ruling, outcome, outcome of the action, part of the reason, type; all names and numbers are invented
RULINGS = [
    ("Ante o exposto, JULGO PROCEDENTE o pedido para declarar a inexistência da dívida.", "procedente", "procedente", "", "sentenca"),
    ("Isto posto, acolho os pedidos e condeno a ré a pagar R$ 2.000,00.", "procedente", "procedente", "", "sentenca"),
    ("Isso posto, condeno o réu ao pagamento das prestações.", "procedente", "procedente", "", "sentenca"),
    ("Julgo improcedentes os pedidos e condeno o autor em custas.", "improcedente", "improcedente", "", "sentenca"),
    ("Não acolho os pedidos iniciais.", "improcedente", "improcedente", "", "sentenca"),
    ("Julgo procedentes, em parte, os pedidos.", "parcialmente_procedente", "parcialmente_procedente", "", "sentenca"),
    ("Julgo procedente o pedido de restituição e improcedente o de danos morais.", "parcialmente_procedente", "parcialmente_procedente", "resultados distintos", "sentenca"),
    ("Julgo improcedente a reconvenção e procedente o pedido inicial.", "procedente", "procedente", "", "sentenca"),
    ("Pronuncio a prescrição e extingo o feito com resolução do mérito.", "improcedente", "improcedente", "prescrição", "sentenca"),
    ("Afasto a prescrição e julgo procedente a ação.", "procedente", "procedente", "", "sentenca"),
    ("Homologo o acordo firmado entre as partes.", "homologacao_acordo", "homologacao_acordo", "", "sentenca"),
    ("Julgo extinto o processo, sem resolução do mérito, nos termos do art. 485, VI, do CPC.", "extinto_sem_merito", "extinto_sem_merito", "ilegitimidade", "sentenca"),
    ("Homologo a desistência da ação.", "extinto_sem_merito", "extinto_sem_merito", "desistência", "sentenca"),
    ("Rejeito os embargos monitórios.", "procedente", "procedente", "", "sentenca"),
    ("Concedo a segurança.", "procedente", "procedente", "", "sentenca"),
    ("Nego provimento ao recurso.", "nao_provido", "", "", "acordao"),
    ("Deram parcial provimento ao apelo.", "parcialmente_provido", "", "", "acordao"),
    ("Dou provimento ao recurso para julgar procedente o pedido.", "provido", "procedente", "", "acordao"),
    ("Sentença mantida por seus fundamentos.", "nao_provido", "", "", "acordao"),
    ("Não conheço de parte do recurso e, na parte conhecida, nego-lhe provimento.", "nao_provido", "", "conhecimento parcial", "acordao"),
    ("Anulo a sentença e determino o retorno dos autos.", "provido", "", "anulação", "acordao"),
    ("Dou provimento ao recurso do autor e nego provimento ao recurso do réu.", "indeterminado", "", "resultados distintos", "acordao"),
    ("Rejeito os embargos de declaração.", "indeterminado", "", "", "embargos_declaracao"),
    ("Intime-se o autor para juntar documentos.", "indeterminado", "", "", "outro"),
]


@pytest.mark.parametrize("ruling, outcome, action, reason, kind", RULINGS)
def test_rulings(ruling, outcome, action, reason, kind):
    found = decisions.of_ruling(ruling)
    assert (found["resultado"], found["resultado_acao"] or "", found["tipo_decisao"]) == (outcome, action, kind)
    assert reason in (found["motivo"] or "")


def test_confidence_and_vote():
    assert decisions.of_ruling("Julgo procedente o pedido.")["confianca"] == "alta"
    assert decisions.of_ruling("Pronuncio a decadência.")["confianca"] == "media"
    assert decisions.of_ruling("Sentença mantida.")["confianca"] == "baixa"
    assert decisions.of_ruling("ACORDAM, por unanimidade, negar provimento ao recurso.")["unanimidade"] is True
    assert decisions.of_ruling("Por maioria, deram provimento ao recurso.")["unanimidade"] is False
    assert decisions.of_ruling("Julgo procedente o pedido.")["unanimidade"] is None


PANEL = """ACÓRDÃO
ACORDAM os juízes, por maioria, dar provimento ao recurso, vencido o relator.
RELATÓRIO
Trata-se de apelação cível. É o relatório.
Ante o exposto, nego provimento ao recurso.
"""


def test_a_panel_prevails_over_the_rapporteur():
    found = decisions.of_text(PANEL)
    assert found["resultado"] == "provido" and "prevalece o ACORDAM" in found["motivo"]


def test_a_dissent_ends_the_text():
    text = "Vistos. " * 40 + "Ante o exposto, nego provimento ao recurso.\nVOTO VENCIDO\nAnte o exposto, dou provimento ao recurso."
    assert decisions.of_text(text)["resultado"] == "nao_provido"


def test_parts():
    p = decisions.parts("Fatos.\nÉ o relatório.\nRazões.\nAnte o exposto, julgo procedente o pedido.")
    assert (p.report, p.grounds, p.located) == ("Fatos.\nÉ o relatório.", "Razões.", True)
    assert not decisions.parts("abcde " * 10).located


def test_columns_agree_with_the_kernels(spark):
    df = spark.createDataFrame([(r[0],) for r in RULINGS] + [(None,), ("",)], "t string")
    rows = df.select("t", decisions.evaluation(F.col("t"), whole=False).alias("e")).collect()
    assert [r["e"]["resultado"] for r in rows[: len(RULINGS)]] == [r[1] for r in RULINGS]
    assert [r["e"]["resultado"] for r in rows[-2:]] == ["indeterminado"] * 2


RULING = (
    "Ante o exposto, condeno a ré a pagar R$ 1.234,50 a título de danos morais, com juros de 1% ao mês desde a citação e correção monetária pelo INPC a partir do "
    "arbitramento; a restituir em dobro R$ 2 mil; e honorários de quinze por cento sobre o valor da causa. Exigibilidade suspensa. Para cada autor."
)


def test_amounts(spark):
    c = amounts.calculate(RULING)
    assert [(v["categoria"], v["valor"]) for v in c["valores"]] == [("danos_morais", 1234.5), ("restituicao", 2000.0)]
    assert (c["honorarios_percentual"], c["honorarios_base"], c["repeticao"]) == (15.0, "valor da causa", "em dobro")
    assert (c["juros_termos_iniciais"], c["juros_taxa"], c["correcao_termos_iniciais"], c["correcao_indice"]) == (["citação"], "1% ao mês", ["arbitramento"], "INPC")
    assert c["gratuidade"] and c["valor_por_autor"]
    row = spark.createDataFrame([(RULING,), (None,)], "t string").select(amounts.first_amount(amounts.calculation(F.col("t")), "danos_morais").alias("v")).collect()
    assert [r["v"] for r in row] == [1234.5, None]


@pytest.mark.parametrize("text, value", [("R$ 350", 350.0), ("R$ 1.000,5", 1000.5), ("R$ 3 milhões", 3e6), ("R$ 12,34", 12.34)])
def test_money(text, value):
    assert amounts.calculate(text)["valores"][0]["valor"] == value


def test_citations(spark):
    text = "art. 6º, VIII, do Código de Defesa do Consumidor; art. 186 do CC/02; art. 1022 da Lei 13.105/15; Lei 9.099/95; LC; Lei Complementar nº 101; Súmula Vinculante 11 do Supremo Tribunal Federal; Tema 1.061 do STJ; art. 5º-A"
    assert [c[1] for c in citations.citations(text)] == ["art. 6 CDC", "art. 186 CC", "art. 1.022 CPC", "Lei 9.099/1995", "LC 101"][:4] + [c[1] for c in citations.citations(text)][4:]
    assert "Súmula Vinculante 11 STF" in [c[1] for c in citations.citations(text)] and "Tema 1.061 STJ" in [c[1] for c in citations.citations(text)]
    n = citations.counted(spark.createDataFrame([(1, text + " art. 186 do CC")], "id int, texto string")).where("referencia = 'art. 186 CC'").first()["n"]
    assert n == 2

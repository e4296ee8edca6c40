"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tabelion.functions import courts, movements, policy, stats, text
from tabelion.operators import pseudonyms


def value(spark, column, *given):
    names = [f"c{i}" for i in range(len(given))]
    return spark.range(1).select(*(F.lit(g).alias(n) for g, n in zip(given, names, strict=True))).select(column(*map(F.col, names)).alias("v")).first()["v"]


def test_text(spark):
    assert value(spark, text.unaccent, "Ação à Ñandu ÇÃO é nº ª") == "Acao a Nandu CAO e nº ª"
    assert value(spark, text.folded, "  JUÍZA\n de\tDireito ") == "juiza de direito"
    assert value(spark, text.tokens, "Boa-fé três 12 d'água") == ["boa-fé", "três", "d", "água"]
    assert value(spark, text.telling_tokens, "O réu e a autora não pagaram, fls. 3, houvesse") == ["réu", "autora", "pagaram"]
    assert value(spark, text.html_to_text, "<p>A&nbsp;&amp; B</p>x<br/>y") == " A & B\nx\ny".strip()
    assert value(spark, text.sentences, "Um. Dois!\nTrês; quatro. cinco") == ["Um.", "Dois!", "Três; quatro. cinco"]
    assert value(spark, text.arguments, "Nada. Com efeito, sim. Não se desincumbiu do ônus.") == ["Com efeito, sim.", "Não se desincumbiu do ônus."]
    assert value(spark, text.term_counts, "Dano moral e danos morais; boa-fé. DANO  MORAL") == {"dano moral": 2, "danos morais": 1, "boa-fé": 1}
    assert len(text.STOP_WORDS) > 180 and {"houvéssemos", "estivermos", "teríamos"} <= set(text.STOP_WORDS)


@pytest.mark.parametrize("given, day", [("20190528000000", "2019-05-28"), ("2019-05-28T00:00:00.000Z", "2019-05-28"), ("2019-05-28", "2019-05-28"), ("20191399", None), ("x", None), ("", None)])
def test_dates(spark, given, day):
    assert value(spark, lambda c: text.any_date(c).cast("string"), given) == day


def test_wilson_and_quartiles(spark):
    p, low, high = spark.range(1).select(*stats.wilson(F.lit(50), F.lit(100))).first()
    assert (p, round(low, 4), round(high, 4)) == (0.5, 0.4038, 0.5962)
    assert list(spark.range(1).select(*stats.wilson(F.lit(0), F.lit(0))).first()) == [None] * 3
    assert spark.range(1, 6).select(stats.quartiles(F.col("id"))).first()[0] == [2.0, 3.0, 4.0]
    assert spark.range(1, 5).select(stats.quartiles(F.col("id"))).first()[0][1] == 2.5


def test_log_odds(spark):
    counts = spark.createDataFrame([("a", 10, 1), ("b", 1, 10), ("c", 5, 5), ("d", 1, 1)], "word string, n_a long, n_b long")
    z = {r["word"]: r["z"] for r in stats.log_odds(counts).collect()}
    assert set(z) == {"a", "b", "c"} and z["a"] > 0 and abs(z["a"] + z["b"]) < 1e-9 and abs(z["c"]) < 1e-9
    assert stats.log_odds(counts.withColumn("n_b", F.lit(0))).count() == 0


def test_courts(spark):
    assert len(courts.COURTS) == 91 and len(courts.select(["estadual"])) == 27 and courts.select(["TJSP", "tjsp", "militar"]) == ["tjsp", "tjmmg", "tjmrs", "tjmsp"]
    assert courts.dimension(spark).count() == 91
    with pytest.raises(ValueError):
        courts.select(["x"])
    n, rest = 1234567, "2020826" + "0100"
    dd = 98 - int(f"{n}{rest}00") % 97
    number = f"{n}-{dd:02d}.2020.8.26.0100"
    assert value(spark, courts.valid_number, number) and not value(spark, courts.valid_number, number.replace(f"-{dd:02d}.", f"-{(dd + 1) % 97:02d}."))
    assert value(spark, courts.case_numbers, f"x {number} y {number.replace('-', '').replace('.', '')} z") == [number]
    assert [value(spark, courts.court_of_number, f"0000000-00.2020.{j}.0000") for j in ("8.26", "8.07", "6.07", "4.03", "5.24", "9.26", "3.00", "7.00", "4.09")] == ["tjsp", "tjdft", "tre-dft", "trf3", "trt24", "tjmsp", "stj", "stm", None]
    assert value(spark, courts.branch_of, "trf1") == "federal" and value(spark, courts.branch_of, "x") == "desconhecido"


def test_policy(spark):
    assert value(spark, lambda c: policy.secret(None, c), "Tramita em SEGREDO DE JUSTIÇA") and not value(spark, lambda c: policy.secret(None, c), "público")
    assert value(spark, lambda c: policy.secret(c), 1) and not value(spark, lambda c: policy.secret(c), 0)
    assert value(spark, lambda a, b: policy.sensitive(a, b), "Divórcio", "x") and not value(spark, policy.sensitive, "cobrança")


@pytest.mark.parametrize(
    "code, name, outcome",
    [(219, "x", "procedente"), (221, None, "parcialmente_procedente"), (0, "Improcedência", "improcedente"), (0, "Procedência em Parte", "parcialmente_procedente"), (0, "Não-Provimento", "nao_provido"), (0, "Provimento", "provido"),
     (0, "Homologação de Transação", "homologacao_acordo"), (219, "Embargos de Declaração - Procedência", None), (0, "Conclusos", None), (0, "Não Conhecimento de recurso", "nao_conhecido")],
)
def test_movements(spark, code, name, outcome):
    assert value(spark, movements.of_movement, code, name) == outcome


def test_first_judgement(spark):
    kind = "array<struct<codigo:int,nome:string,dataHora:string>>"
    df = spark.createDataFrame([([(1, "Conclusos", "2020"), (220, "Improcedência", "2022"), (219, "Procedência", "2021")],), ([],)], f"m {kind}")
    assert [tuple(r["j"]) for r in df.select(movements.first_judgement(F.col("m")).alias("j")).collect()] == [("procedente", "219 Procedência", "2021"), ("indeterminado", "", None)]


DECISION = "Autor: JOÃO PEDRO DA SILVA, brasileiro, CPF 123.456.789-09, e-mail jp@exemplo.com.br, residente na Rua das Flores, 12, CEP 01234-567. Réu: BANCO EXEMPLO S.A.\nJoão Pedro da Silva alega.\nMARIA LIMA\nOAB/SP 123.456"


def test_pseudonyms(spark):
    p = pseudonyms.pseudonymised(spark.createDataFrame([(DECISION,)], "texto string")).first()["p"]
    for gone in ("JOÃO", "João", "123.456", "jp@", "Flores", "MARIA"):
        assert gone not in p["texto"]
    assert "BANCO EXEMPLO S.A." in p["texto"] and p["texto"].count("[PESSOA_1]") == 2
    assert p["substituicoes"] == {"EMAIL": 1, "CPF": 1, "OAB": 1, "CEP": 1, "ENDERECO": 1, "PESSOA": 3}
    assert value(spark, lambda t: pseudonyms.residue(pseudonyms.masked(t)), DECISION) == []
    assert pseudonyms.without_names("Ana Souza falou", ["Ana Souza", "", "Eu"]) == ("[PESSOA_1] falou", 1)


def test_entities_and_letters(spark):
    """Every named entity and numbers, once; letters composed; accents of all Latin letters."""
    import unicodedata

    for given, wanted in (
        ("a &amp;lt; b &lt;x&gt; &copy;", "a &lt; b <x> ©"), ("&eacute;&#233;&#xE9;&#x1F600;", "ééé😀"), ("&nosuch; & &amp", "&nosuch; & &amp"), ("&#0; &#xD800; &#9999999;", "&#0; &#xD800; &#9999999;"),
        ("&middot;" * 50, "·" * 50), ("", ""), ("no entity", "no entity"),
    ):
        assert value(spark, text.unescaped, given) == wanted
    letters = "".join(unicodedata.normalize("NFD", c) for c in "ação èñüŷẽ São Tomé ǎ")
    assert value(spark, text.composed, letters) == unicodedata.normalize("NFC", letters)
    assert value(spark, text.unaccent, "Ação ŷẽǎ Ñ ø") == "Acao yea N ø"
    assert value(spark, text.html_to_text, "<p>A&ccedil;&atilde;o&nbsp;&#8211; fim</p>") == "Ação – fim\n"


def test_a_recogniser_adds_names(spark):
    """Names of a model count beside those of the patterns; companies stay."""
    found = lambda texts: [[w for w in ("zeca", "Banco Alfa") if w in t] for t in texts]
    p = pseudonyms.pseudonymised(spark.createDataFrame([("Autor: Ana Souza. Disse zeca ao Banco Alfa.",)], "texto string"), recogniser=found).first()["p"]
    assert p["texto"] == "Autor: [PESSOA_1]. Disse [PESSOA_2] ao Banco Alfa." and p["substituicoes"] == {"PESSOA": 2}

"""Consolidation, measures, storage, streaming, collection and report on small invented corpora."""

import csv
import json
import os
import tempfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabelion.operators import consolidate, measures, validate
from tabelion.plans import analytics, collect, document, readings, registry, report  # noqa: F401
from tabelion.sources import config, convert, files, paged
from tabelion.sources.corpus import Corpus
from tabelion.sources.http import Client, HttpError
from tabelion.streaming import ingest

CASE = "tribunal string, numero string, grau string, classe_nome string, assuntos array<struct<codigo:int,nome:string>>, data_ajuizamento date, data_julgamento date, duracao_dias int, resultado string, sensivel boolean"
DOC = f"id string, tribunal string, numero string, data date, classe_nome string, resultado string, sensivel boolean, avaliacao struct<tipo_decisao:string,confianca:string,motivo:string,resultado_acao:string,capitulos:array<{measures.__name__ and 'struct<resultado:string,objeto:string,forca:string>'}>>, calculo struct<valores:array<struct<categoria:string,valor:double>>>"


def case(numero, grau, resultado, tribunal="tjsp"):
    return (tribunal, numero, grau, "c", [], None, None, 10, resultado, False)


def doc(id_, numero, kind, resultado, day="2020-01-01"):
    from datetime import date

    return (id_, "tjsp", numero, date.fromisoformat(day), "c", resultado, False, (kind, "alta", None, None, []), None)


def test_consolidation(spark):
    cases = spark.createDataFrame([case("1-1", "G1", "improcedente"), case("22", "G1", "procedente"), case("22", "G2", "provido"), case("", "JE", "procedente"), case("9", "??", "procedente")], CASE)
    docs = spark.createDataFrame([doc("a", "11", "sentenca", "indeterminado", "2019-01-01"), doc("b", "11", "sentenca", "procedente"), doc("c", "11", "sentenca", "improcedente", "2021-01-01"), doc("d", None, "acordao", "nao_provido"), doc("e", "5", "embargos_declaracao", "indeterminado")], DOC)
    u = {(r["numero"], r["instancia"]): r for r in consolidate.consolidate(cases, docs).collect()}
    assert set(u) == {("11", "1"), ("22", "1"), ("22", "2"), ("", "1"), ("doc:d", "2")}
    assert (u["11", "1"]["resultado"], u["11", "1"]["fonte"], u["11", "1"]["divergente"], u["11", "1"]["confianca"]) == ("procedente", "ambos", True, "alta")
    assert (u["22", "1"]["fonte_resultado"], u["22", "1"]["confianca"], u["22", "2"]["grau"]) == ("movimentos", "media", "G2")


UNIT = "tribunal string, resultado string, instancia string, numero string, resultado_acao string, motivo string"


def test_national_rates_and_suppression(spark):
    rows = [("tjsp", "procedente", "1", str(i), None, None) for i in range(90)] + [("tjsp", "improcedente", "1", str(i), None, None) for i in range(90, 100)] + [("tjrj", "parcialmente_procedente", "1", str(i), None, None) for i in range(200, 202)] + [("tjrj", "improcedente", "1", str(i), None, None) for i in range(202, 210)] + [("tjac", "procedente", "1", "x", None, None)]
    u = spark.createDataFrame(rows, UNIT)
    n = {r["medida"]: r for r in measures.national_rates(u).collect()}
    assert (n["acolhimento"]["n"], n["acolhimento"]["tribunais"]) == (111, 2) and n["acolhimento"]["media_tribunais"] == pytest.approx((0.9 + 0.2) / 2) and "provimento" not in n
    assert [r["grupo"] for r in measures.rates(u, "tribunal").collect()] == ["TJSP", "TJRJ"]


def test_reversals(spark):
    rows = []
    for i, (first, second, action, reason) in enumerate([("procedente", "provido", None, None), ("improcedente", "provido", None, None), ("procedente", "nao_provido", None, None), ("parcialmente_procedente", "provido", None, None), ("procedente", "provido", None, "anulação da sentença"), ("procedente", "parcialmente_provido", None, None), ("procedente", "provido", "parcialmente_procedente", None), ("extinto_sem_merito", "provido", None, None)]):
        rows += [("t", first, "1", str(i), None, None), ("t", second, "2", str(i), action, reason)]
    pairs = measures.appealed(spark.createDataFrame(rows + [("t", "procedente", "1", "doc:1", None, None)], UNIT))
    assert [r["final"] for r in pairs.orderBy("numero").collect()] == ["improcedente", "procedente", "procedente", "indeterminado (ambas as partes podem ter recorrido)", "sentença anulada", "parcialmente_procedente", "parcialmente_procedente"]
    assert measures.reversal_rate(pairs).first().asDict() == {"pares": 7, "taxa_reforma": pytest.approx(6 / 7)}


def test_parameters_keep_shares_of_all(spark):
    kind = "instancia string, resultado string, calculo struct<valores:array<struct<categoria:string,valor:double>>,honorarios_percentual:double,repeticao:string,juros_termos_iniciais:array<string>,juros_taxa:string,correcao_termos_iniciais:array<string>,correcao_indice:string>"
    rows = [("1", "procedente", ([("danos_morais", 1000.0 * (i + 1))], 10.0, None, ["citação"], None, None, None)) for i in range(10)] + [("1", "procedente", ([("danos_morais", 0.5)], 12.5, None, None, None, None, None))]
    u = spark.createDataFrame(rows, kind).withColumn("tribunal", F.lit("tjsp"))
    found = {(r["parametro"], r["valor"]): (r["n"], r["proporcao"]) for r in measures.calculation_parameters(u).collect()}
    assert found == {("honorários (%)", "10%"): (10, pytest.approx(10 / 11)), ("juros: termo inicial", "citação"): (10, 1.0)}
    assert measures.award_amounts(u).first().asDict() == {"grupo": "TJSP", "n": 10, "mediana": 5500.0, "q1": 3250.0, "q3": 7750.0}


def test_validation(spark):
    rows = spark.createDataFrame([("procedente", "procedente")] * 9 + [("Improcedente ", "procedente"), ("", "x")], "resultado_manual string, resultado_automatico string")
    matrix = validate.confusion(validate.labelled(rows))
    assert validate.accuracy(matrix).first().asDict() == {"n": 10, "acuracia": 0.9}
    m = {r["rotulo"]: r for r in validate.label_metrics(matrix).collect()}
    assert (m["procedente"]["precisao"], m["procedente"]["cobertura"], m["improcedente"]["f1"], m["improcedente"]["suporte"]) == (0.9, 1.0, 0.0, 1)
    df = spark.range(100).select("id", F.when(F.col("id") < 95, "a").otherwise("b").alias("l"))
    s = validate.stratified(df, "l", 10, "id").collect()
    assert len(s) == 10 and sum(r["l"] == "b" for r in s) == 5


JOB = """
nome = "teste"
tribunais = ["tjsp", "tjrj"]
[datajud]
graus = ["G1"]
ajuizamento_desde = 2019-01-01
tamanho_pagina = 2
[djen]
data_inicio = 2025-01-01
data_fim = 2025-01-02
tipos_documento = ["Sentença"]
itens_por_pagina = 1
"""


def hit(n, day="20190528000000", level=0):
    return {"_source": {"numeroProcesso": str(n), "classe": {"codigo": 1, "nome": "Procedimento"}, "assuntos": [[{"codigo": 5, "nome": "Cobrança"}], {"codigo": 6, "nome": "Juros"}, 3], "grau": "G1", "dataAjuizamento": day, "nivelSigilo": level, "movimentos": [{"codigo": 219, "nome": "Procedência", "dataHora": "2020-05-27T00:00:00.000Z"}]}, "sort": [n]}


def transport(method, url, headers, body):
    """Three pages of two, two and one hits for each court; one notice a day."""
    if method == "POST":
        query = json.loads(body)
        if query["size"] == 0:
            return json.dumps({"hits": {"total": {"value": 5}}}).encode()
        base = 100 if "tjsp" in url else 200
        all_hits = [hit(base + i, "20180101" if i == 3 else "20190528000000", int(i == 4)) for i in range(5)]
        after = query.get("search_after", [0])[0]
        return json.dumps({"hits": {"hits": [h for h in all_hits if h["sort"][0] > after][: query["size"]]}}).encode()
    page = int(url.split("pagina=")[1].split("&")[0])
    court, day = url.split("siglaTribunal=")[1].split("&")[0], url.split("Inicio=")[1][:10]
    item = {"id": f"{court}{day}", "texto": "<p>Autora: ANA LIMA ROCHA.</p>Ante o exposto, julgo procedente o pedido.", "tipoDocumento": "Sentença" if day.endswith("1") else "Despacho", "data_disponibilizacao": day, "destinatarios": [{"nome": "Ana Lima Rocha"}]}
    return json.dumps({"items": [item] if page == 1 else []}).encode()


def test_collection(spark, tmp_path):
    (tmp_path / "job.toml").write_text(JOB)
    job = config.load(tmp_path / "job.toml")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    name = "tests.test_corpus:transport"
    assert collect.estimate(job, name) == {"tjsp": 5, "tjrj": 5}
    assert collect.cases(spark, job, corpus, name) == 6  # one of five is filed too early, one is secret
    row = corpus.cases().where("numero = '100'").first()
    assert (row["duracao_dias"], row["resultado"], [a["nome"] for a in row["assuntos"]]) == (365, "procedente", ["Cobrança", "Juros"])
    assert corpus.cursors("datajud", "teste")["tjsp"][1] and "x" not in corpus.cursors("datajud", "teste")
    assert collect.cases(spark, job, corpus, name) == 0
    assert collect.notices(spark, job, corpus, name) == 2
    d = corpus.documents().first()
    assert "Ana" not in d["texto"] and "ANA" not in d["texto"] and d["resultado"] == "procedente" and d["id"].startswith("djen:")
    assert corpus.summary() == {"processos": 6, "documentos": 2, "tribunais": 2, "substituicoes": 2}


FAILING, ASKED = (Path(tempfile.gettempdir()) / f"tabelion-test-{name}-{os.getuid()}" for name in ("failing", "asked"))


def failing_transport(method, url, headers, body):
    """transport() with a log of what was asked for, that fails past the second page while a marker stands."""
    after = json.loads(body).get("search_after", [0])[0]
    if FAILING.exists() and after % 100 > 1:
        raise RuntimeError("the collector dies here")
    with ASKED.open("a") as f:
        f.write(f"{'tjsp' if 'tjsp' in url else 'tjrj'}:{after}\n")
    return transport(method, url, headers, body)


def test_collection_goes_on_where_it_died(spark, tmp_path):
    (tmp_path / "job.toml").write_text(JOB)
    job, corpus, name = config.load(tmp_path / "job.toml"), Corpus(spark, f"file://{tmp_path}/corpus"), "tests.test_corpus:failing_transport"
    ASKED.unlink(missing_ok=True)
    FAILING.touch()
    try:
        with pytest.raises(Exception, match="dies here"):
            collect.cases(spark, job, corpus, name, pages=1)
            collect.cases(spark, job, corpus, name, pages=1)
    finally:
        FAILING.unlink()
    assert {c: (at["after"], at["seen"], done) for c, (at, done) in corpus.cursors("datajud", "teste").items()} == {"tjsp": ([103], 4, False), "tjrj": ([203], 4, False)}
    asked = ASKED.read_text().split()
    assert collect.cases(spark, job, corpus, name, pages=1) == 6
    later = ASKED.read_text().split()[len(asked) :]
    assert "tjsp:0" not in later and "tjrj:0" not in later and all(done for _, done in corpus.cursors("datajud", "teste").values())
    ASKED.unlink()


def test_paging_and_query():
    q = config.CaseQuery(assuntos_nomes=["x"], graus=["G1", "JE"], tamanho_pagina=2, limite_por_tribunal=3)
    sizes = [len(h) for h, _, _ in paged.case_pages(Client(transport, interval=0), "tjsp", q)]
    assert sizes == [2, 1]
    body = paged.case_query(q, 2, [7])
    assert [len(m["bool"]["should"]) for m in body["query"]["bool"]["must"]] == [1, 2] and body["search_after"] == [7]
    assert paged.case_query(config.CaseQuery(), 5)["query"] == {"match_all": {}}


def test_retries():
    tries, waits = [], []

    def flaky(*_):
        tries.append(1)
        if len(tries) < 3:
            raise HttpError(503)
        return b"{}"

    assert Client(flaky, interval=0, sleep=waits.append).request("GET", "http://x")[0] == {} and waits == [2, 4]

    def refused(*_):
        raise HttpError(403)

    with pytest.raises(HttpError):
        Client(refused, interval=0, sleep=waits.append).request("GET", "http://x")
    assert waits == [2, 4]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ante o exposto, julgo improcedente o pedido.")
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Nego provimento ao recurso.</w:t></w:r></w:p></w:document>')
    (tmp_path / "c.txt").write_text("  ")
    (tmp_path / "d.csv").write_text("x")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    rows, failures = files.read(spark, str(tmp_path))
    assert sorted(r["resultado"] for r in convert.documents(rows).collect()) == ["improcedente", "nao_provido"]
    assert sorted(Path(r["path"]).name for r in failures.collect()) == ["c.txt", "e.docx"]


def test_streaming_counts_a_repeated_row_once(spark, tmp_path):
    (tmp_path / "job.toml").write_text(JOB)
    job, corpus = config.load(tmp_path / "job.toml"), Corpus(spark, f"file://{tmp_path}/corpus")
    landing = tmp_path / "landing"
    landing.mkdir()
    for k in range(2):
        rows = [{"tribunal": "tjsp", "cursor": "1", "hit": json.dumps(hit(n)), "proveniencia": {"url": "u", "metodo": "POST", "parametros": "", "coletado_em": f"2025-01-0{k + 1}", "sha256": "s"}} for n in range(3 + k)]
        (landing / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest.cases(spark, job, corpus, str(landing), str(tmp_path / "checkpoint")).awaitTermination()
    assert corpus.cases().count() == 4


def test_report(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    assert "ainda está vazio" in report.generate(corpus, tmp_path / "empty").read_text()
    texts = ["Autor: CARLOS NUNES. Aplica-se o art. 14 do CDC. Ante o exposto, julgo procedente o pedido.", "A Súmula 385 do STJ afasta o dano. Ante o exposto, julgo improcedente o pedido."]
    raw = spark.range(40).select(F.col("id").cast("string").alias("chave"), F.lit("tjsp").alias("tribunal"), F.col("id").cast("string").alias("numero"), F.lit("s").alias("tipo"), F.lit(None).cast("date").alias("data"), F.lit("c").alias("classe_nome"), F.lit(None).cast("string").alias("url"), F.array().cast("array<string>").alias("nomes"), F.when(F.col("id") % 2 == 0, texts[0]).otherwise(texts[1]).alias("bruto"), F.lit(None).cast("struct<url:string>").alias("proveniencia"))
    corpus.upsert_documents(convert.documents(raw))
    corpus.upsert_cases(spark.createDataFrame([case(str(i), "G1", "procedente", "tjrj") for i in range(12)] + [case("900", "G1", "procedente", "tjac")], CASE))
    page = report.generate(corpus, tmp_path / "out", "Título").read_text()
    assert "<svg" in page and "prefers-color-scheme: dark" in page and not {"CARLOS", "TJAC"} & set(page.replace("<", " ").replace(">", " ").split())
    with (tmp_path / "out" / "citacoes.csv").open() as f:
        assert {(r["citacao"], r["em_acolhidos"]) for r in csv.DictReader(f)} == {("art. 14 CDC", "1.0"), ("Súmula 385 STJ", "0.0")}
    assert json.loads((tmp_path / "out" / "metadados.json").read_text())["licenca"] == "CC BY 4.0"
    found = json.loads(document.analyse_text(spark, texts[0]))
    assert found["avaliacao"]["resultado"] == "procedente" and found["citacoes"] == {"art. 14 CDC": 1}


def test_every_query_runs(spark, small):
    for name in ("rates_by_nation", "consolidated_units", "case_number_check", "rulings_evaluated", "documents_masked"):
        assert registry.queries()[name](spark, small).count() > 0, name


def test_charts():
    """Each kind of chart draws a mark a row, names escaped, and gives an empty drawing for no rows."""
    crossed = [{"sentenca": "a<b", "recurso": "p", "n": 3}, {"sentenca": "a<b", "recurso": "q", "n": 1}, {"sentenca": "c", "recurso": "p", "n": 2}]
    assert report.chart("reforma_cruzamento", crossed).count("<title>") == 3 and "a&lt;b" in report.chart("reforma_cruzamento", crossed)
    assert 'width="285.0"' in report.chart("reforma_cruzamento", crossed)  # three quarters
    quartiles = [{"grupo": "x", "n": 10, "mediana_dias": 5.0, "q1_dias": 2.0, "q3_dias": 10.0}, {"grupo": "y", "n": 10, "mediana_dias": None, "q1_dias": None, "q3_dias": None}]
    assert report.chart("duracao_tribunal", quartiles).count("<circle") == 1
    assert report.chart("taxas_ano", [{"grupo": str(y), "acolhimento": y / 4000} for y in (2019, 2020, 2021)]).count("<circle") == 3
    assert report.chart("citacoes", [{"citacao": "art. 1", "documentos": 3, "em_acolhidos": 0.5, "em_rejeitados": 0.25}]).count("<rect") == 2
    assert report.chart("vocabulario_acolhido", [{"palavra": "w", "z": -2.0, "n_acolhidos": 1}]).count("<rect") == 1
    assert all(f.count("<rect") + f.count("<circle") == 0 for f in (report.bars([], "a", "b"), report.ranges([], "a", "b", "c", "d"), report.stacked([], "a", "b", "c"), report.pairs_of_bars([], "a", "b", "c"), report.line([], "a", "b")))


def test_one_analysis_is_drawn(spark):
    found = document.analyse_text(spark, "Contrato, contrato e cobrança. Ante o exposto, julgo procedente o pedido.")
    drawn = document.drawing(found)
    assert drawn.startswith("<svg xmlns") and drawn.count("<rect") >= 2 and "contrato" in drawn

"""From raw case hits, notices and files to the corpus tables. Original text goes no further than here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabelion.functions import courts, movements, policy, stats, text
from tabelion.operators import amounts, decisions, pseudonyms
from tabelion.sources.config import CaseQuery, NoticeQuery

HIT = (
    "_source struct<numeroProcesso:string,classe:struct<codigo:int,nome:string>,assuntos:string,grau:string,dataAjuizamento:string,orgaoJulgador:struct<codigoMunicipioIBGE:int>,"
    "nivelSigilo:int,movimentos:array<struct<codigo:int,nome:string,dataHora:string>>>"
)
NOTICE = (
    "id string, hash string, texto string, conteudo string, numeroprocessocommascara string, numero_processo string, numeroProcesso string, nomeClasse string, classe string, tipoDocumento string, "
    "tipoComunicacao string, data_disponibilizacao string, datadisponibilizacao string, link string, destinatarios array<struct<nome:string>>, "
    "destinatarioadvogados array<struct<nome:string,advogado:struct<nome:string>>>"
)
_SUBJECT = "struct<codigo:int,nome:string>"


def subjects(raw: Column) -> Column:
    """Subjects of a JSON list whose items are objects or lists of objects; anything else is dropped."""
    items = F.from_json(raw, "array<string>")
    one = lambda x: F.when(x.startswith("["), F.from_json(x, f"array<{_SUBJECT}>")).when(x.startswith("{"), F.array(F.from_json(x, _SUBJECT)))
    return F.coalesce(F.flatten(F.filter(F.transform(items, one), lambda x: x.isNotNull())), F.array().cast(f"array<{_SUBJECT}>"))


def cases(raw: DataFrame, q: CaseQuery | None = None) -> DataFrame:
    """The case table from rows of court_cases: classified, secret ones and those out of the filing period dropped."""
    s = F.col("s")
    parsed = raw.select("tribunal", "cursor", "proveniencia", F.from_json("hit", HIT)["_source"].alias("s"))
    listed = subjects(s["assuntos"])
    judged = movements.first_judgement(F.coalesce(s["movimentos"], F.array().cast("array<struct<codigo:int,nome:string,dataHora:string>>")))
    found = parsed.withColumns({"assuntos": listed, "j": judged})
    filed, decided = text.any_date(s["dataAjuizamento"]), text.any_date(F.col("j.data"))
    table = found.where(~policy.secret(s["nivelSigilo"])).select(
        "tribunal", F.coalesce(s["numeroProcesso"], F.lit("")).alias("numero"), F.coalesce(s["grau"], F.lit("")).alias("grau"), s["classe"]["codigo"].alias("classe_codigo"), s["classe"]["nome"].alias("classe_nome"),
        "assuntos", s["orgaoJulgador"]["codigoMunicipioIBGE"].alias("municipio_ibge"), filed.alias("data_ajuizamento"), decided.alias("data_julgamento"), stats.days_between(filed, decided).alias("duracao_dias"),
        F.col("j.resultado").alias("resultado"), F.col("j.evidencia").alias("evidencia"),
        policy.sensitive(s["classe"]["nome"], F.array_join(F.transform("assuntos", lambda a: F.coalesce(a["nome"], F.lit(""))), " ")).alias("sensivel"), "proveniencia", "cursor",
    )
    if q and q.ajuizamento_desde:
        table = table.where(F.col("data_ajuizamento") >= F.lit(q.ajuizamento_desde))
    if q and q.ajuizamento_ate:
        table = table.where(F.col("data_ajuizamento") <= F.lit(q.ajuizamento_ate))
    return table


def wanted_type(kind: Column, types: list[str]) -> Column:
    """Whether a type holds any of the wanted ones, without regard to case and accents; all for none."""
    plain = text.unaccent(F.lower(F.coalesce(kind, F.lit(""))))
    found = F.lit(not types)
    for t in types:
        found |= F.contains(plain, text.unaccent(F.lower(F.lit(t))))
    return found


def documents(raw: DataFrame, original: str = "bruto", source: str = "arquivo") -> DataFrame:
    """The document table from rows (chave, tribunal, numero, tipo, data, classe_nome, url, nomes, bruto, proveniencia).

    HTML to text, secrecy, pseudonyms, evaluation and parameters, in this order. Rows without text and secret ones are dropped.
    """
    plain = F.when(F.contains(F.col(original), F.lit("<")), text.html_to_text(F.col(original))).otherwise(F.col(original))
    stays = F.monotonically_increasing_id() >= 0  # a filter that went below this step would spell it out, and read the markup again, for each of its tests
    kept = raw.withColumn("plain", F.when(stays, plain)).where((F.trim(F.coalesce("plain", F.lit(""))) != "") & ~policy.secret(None, F.col("plain")))
    kept = pseudonyms.pseudonymised(kept, "plain", "nomes")
    kept = kept.withColumn("avaliacao", decisions.evaluation(F.col("p.texto")))
    kept = kept.withColumn("calculo", amounts.calculation(F.col("avaliacao.dispositivo")))
    number = F.coalesce(F.get(courts.case_numbers(F.col("numero")), F.lit(0)), F.col("numero"))
    return kept.select(
        F.concat(F.lit(f"{source}:"), F.coalesce("chave", F.sha2(original, 256))).alias("id"), F.lit(source).alias("fonte"), "tribunal", number.alias("numero"), "tipo", "data", "classe_nome",
        F.col("p.texto").alias("texto"), F.sha2(original, 256).alias("sha256_original"), F.col("avaliacao.resultado").alias("resultado"), F.col("avaliacao.evidencia").alias("evidencia"),
        policy.sensitive(F.col("classe_nome"), F.substring("plain", 1, policy.SENSITIVE_HEAD)).alias("sensivel"), F.col("p.substituicoes").alias("substituicoes"), "url", "proveniencia", "avaliacao", "calculo",
    )


def notices(raw: DataFrame, q: NoticeQuery | None = None) -> DataFrame:
    """The document table from rows of court_notices."""
    n = raw.select("tribunal", "proveniencia", F.from_json("hit", NOTICE).alias("n")).select("tribunal", "proveniencia", "n.*")
    given = lambda *names: text.first_given(*map(F.col, names))
    kind = given("tipoDocumento", "tipoComunicacao")
    people = F.filter(F.concat(F.coalesce(F.col("destinatarios")["nome"], F.array().cast("array<string>")), F.coalesce(F.transform("destinatarioadvogados", lambda a: F.coalesce(a["advogado"]["nome"], a["nome"])), F.array().cast("array<string>"))), lambda x: x.isNotNull())
    rows = n.where(wanted_type(kind, q.tipos_documento if q else [])).select(
        given("id", "hash").alias("chave"), "tribunal", given("numeroprocessocommascara", "numero_processo", "numeroProcesso").alias("numero"), kind.alias("tipo"),
        F.to_date(F.substring(given("data_disponibilizacao", "datadisponibilizacao"), 1, 10)).alias("data"), given("nomeClasse", "classe").alias("classe_nome"), F.col("link").alias("url"), people.alias("nomes"),
        F.coalesce(given("texto", "conteudo"), F.lit("")).alias("bruto"), "proveniencia",
    )
    return documents(rows, source="djen")

"""Registered queries of the operators that read texts, movements and source records, each over a whole table.

The given tables hold no court decisions, so each order is dealt one of the invented texts in examples.py, which say what
must be read in it; the SQL deals the expected values alike. Each text stands between lines with the order's own number, date and page, so
no order's text is another's and nothing is read once for many.
"""

from __future__ import annotations

import math
import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.functions import courts, movements, policy, text
from tabelion.operators import amounts, citations, consolidate, decisions, measures, pseudonyms, validate
from tabelion.plans import examples
from tabelion.plans.registry import query, table
from tabelion.sources import convert
from tabelion.sources.config import CaseQuery
from tabelion.sources.corpus import Corpus


def sql_value(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value)
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: Rows that a task gets, about, where each takes long.
ROWS_A_TASK = 50_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows shared out before work that takes long for each row, to more tasks the more rows there are: by row groups and splits of the
    table it would be left to few tasks, whose rows grow with the table. Counting reads the footers of the table's files only.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_A_TASK)), key)


#: What is written before and after the examples, so that no order's text is another's.
BEFORE, AFTER = "Autos {key} de {date}, folha {page}.\n", "\nProtocolo {key}."


def framed(text: str, sql: bool = False) -> str:
    """SQL of a text (an expression) between BEFORE and AFTER."""
    fill = {"key": "o_orderkey", "date": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))" if sql else "CAST(to_date(o_orderdate) AS STRING)", "page": "o_custkey"}
    part = lambda t: " || ".join(fill[x] if i % 2 else "'" + x.replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(re.split(r"[{}]", t)))
    return f"{part(BEFORE)} || {text} || {part(AFTER)}"


def unframed(text: Column) -> Column:
    """text without what framed() put around it; anything that was changed in there stays and shows."""
    pattern = lambda t: re.sub(r"\\{\w+\\}", r"[0-9-]+", re.escape(t))
    return F.regexp_replace(text, f"^{pattern(BEFORE)}|{pattern(AFTER)}$", "")


def dealt(spark: SparkSession, sf_dir: str, rows: tuple, at: int | None = 0, frame: bool = True) -> DataFrame:
    """k and t of every order: its example's number and its text, framed (or the whole example, at=None)."""
    k = (F.col("o_orderkey") % len(rows)).cast("int")
    of = lambda i: F.array(*(F.lit(row[i]) for row in rows))
    found = F.get(of(at), k) if at is not None else F.struct(*(F.get(of(i), k).alias(f"c{i}") for i in range(len(rows[0]))))
    given = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey").withColumn("t", found)
    return given.select("o_orderkey", k.alias("k"), F.expr(framed("t")).alias("t") if frame and at is not None else F.col("t"))


def expected(rows: tuple, **columns: tuple[int, str]) -> str:
    """SQL of the rows (k, the named columns, n): name=(place in an example, SQL type)."""
    values = ", ".join(f"({k}, {', '.join(sql_value(row[i]) for i, _ in columns.values())})" for k, row in enumerate(rows))
    named = ", ".join(f"{n}::{t} AS {n}" for n, (_, t) in columns.items())
    return f"SELECT k, {named}, count(*) AS n FROM orders JOIN (VALUES {values}) e(k, {', '.join(columns)}) ON o_orderkey % {len(rows)} = k GROUP BY ALL"


def counted(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("k", *(c.alias(n) for n, c in columns.items())).groupBy("k", *columns).agg(F.count("*").alias("n"))


def barred(items: Column) -> Column:
    return F.array_join(items, "|")


@query(expected(examples.RULINGS, resultado=(1, "VARCHAR"), resultado_acao=(2, "VARCHAR"), tipo_decisao=(3, "VARCHAR"), confianca=(4, "VARCHAR")))
def rulings_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 41 rules, overlaps, objects and decision tables."""
    e = dealt(spark, sf_dir, examples.RULINGS).withColumn("e", decisions.evaluation(F.col("t"), whole=False))
    return counted(e, resultado=F.col("e.resultado"), resultado_acao=F.coalesce("e.resultado_acao", F.lit("")), tipo_decisao=F.col("e.tipo_decisao"), confianca=F.col("e.confianca"))


@query(expected(examples.DISMISSALS, motivo=(1, "VARCHAR")))
def dismissal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dealt(spark, sf_dir, examples.DISMISSALS).withColumn("e", decisions.evaluation(F.col("t"), whole=False))
    return counted(e, motivo=F.col("e.motivo"))


@query(expected(examples.DECISIONS, relatorio=(1, "VARCHAR"), fundamentacao=(2, "VARCHAR")))
def decision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dealt(spark, sf_dir, examples.DECISIONS).withColumn("s", decisions.sections(F.col("t")))
    return counted(s, relatorio=unframed(F.col("s.relatorio")), fundamentacao=unframed(F.col("s.fundamentacao")))


@query(expected(examples.DECISIONS, dispositivo=(3, "VARCHAR"), localizado=(4, "BOOLEAN"), resultado=(5, "VARCHAR"), unanimidade=(6, "BOOLEAN")))
def decisions_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dealt(spark, sf_dir, examples.DECISIONS).withColumn("e", decisions.evaluation(F.col("t")))
    return counted(e, dispositivo=unframed(F.col("e.dispositivo")), localizado=F.col("e.dispositivo_localizado"), resultado=F.col("e.resultado"), unanimidade=F.col("e.unanimidade"))


_OUTCOMES = ", ".join(f"({k}, '{row[5]}')" for k, row in enumerate(examples.DECISIONS))


@query(f"SELECT r <> CASE o_orderstatus WHEN 'F' THEN 'procedente' ELSE 'improcedente' END AS mudou, count(*) AS n FROM orders JOIN (VALUES {_OUTCOMES}) e(k, r) ON o_orderkey % {len(examples.DECISIONS)} = k GROUP BY 1")
def decisions_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' status as the outcome that was stored before."""
    status = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "procedente").otherwise("improcedente").alias("resultado"))
    documents = dealt(spark, sf_dir, examples.DECISIONS).withColumnRenamed("t", "texto").join(status, "o_orderkey")
    return decisions.reclassified(documents).groupBy("mudou").agg(F.count("*").alias("n"))


@query(expected(examples.CITED, referencias=(1, "VARCHAR")))
def citations_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(spark, sf_dir, examples.CITED).withColumn("c", citations.cited(F.col("t")))
    return counted(c, referencias=barred(F.col("c")["referencia"]))


@query("SELECT referencia, count(*) AS n FROM (SELECT unnest(string_split(r, '|')) AS referencia FROM orders JOIN (VALUES " + ", ".join(f"({k}, '{r}')" for k, (_, r) in enumerate(examples.CITED)) + f") e(k, r) ON o_orderkey % {len(examples.CITED)} = k) WHERE referencia <> '' GROUP BY 1")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.counted(dealt(spark, sf_dir, examples.CITED), "t")


@query(expected(examples.AMOUNTS, valores=(1, "VARCHAR")))
def amounts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(spark, sf_dir, examples.AMOUNTS).withColumn("c", amounts.calculation(F.col("t")))
    return counted(c, valores=barred(F.transform(F.col("c.valores"), lambda v: F.concat_ws("=", v["categoria"], v["valor"].cast("string")))))


_CALCULATED = {"honorarios": (1, "DOUBLE"), "base": (2, "VARCHAR"), "repeticao": (3, "VARCHAR"), "juros": (4, "VARCHAR"), "taxa": (5, "VARCHAR"), "correcao": (6, "VARCHAR"), "indice": (7, "VARCHAR"), "gratuidade": (8, "BOOLEAN"), "por_autor": (9, "BOOLEAN")}


@query(expected(examples.CALCULATIONS, **_CALCULATED))
def calculations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(spark, sf_dir, examples.CALCULATIONS).withColumn("c", amounts.calculation(F.col("t")))
    names = ("honorarios_percentual", "honorarios_base", "repeticao", "juros_termos_iniciais", "juros_taxa", "correcao_termos_iniciais", "correcao_indice", "gratuidade", "valor_por_autor")
    values = (barred(F.col(f"c.{n}")) if n.endswith("_iniciais") else F.col(f"c.{n}") for n in names)
    return counted(c, **dict(zip(_CALCULATED, values, strict=True)))


_PARAMETERS = (("honorários (%)", 1), ("repetição do indébito", 3), ("juros: termo inicial", 4), ("juros: taxa", 5), ("correção: termo inicial", 6), ("correção: índice", 7))
_PARAMETER_ROWS = ", ".join(f"({k}, '{name}', {sql_value(f'{row[i]:g}%' if i == 1 else row[i])})" for k, row in enumerate(examples.CALCULATIONS) for name, i in _PARAMETERS if row[i])


@query(f"""SELECT parametro, valor, n, round(n / sum(n) OVER (PARTITION BY parametro), 6) AS proporcao FROM (SELECT parametro, valor, count(*) AS n FROM orders JOIN (VALUES {_PARAMETER_ROWS}) e(k, parametro, valor) ON o_orderkey % {len(examples.CALCULATIONS)} = k GROUP BY ALL)
QUALIFY n >= 10""")
def calculation_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = dealt(spark, sf_dir, examples.CALCULATIONS).withColumn("calculo", amounts.calculation(F.col("t"))).withColumns({"instancia": F.lit("1"), "resultado": F.lit("procedente")})
    return measures.calculation_parameters(u).select("parametro", "valor", "n", F.round("proporcao", 6).alias("proporcao"))


@query(expected(examples.PERSONAL, texto=(1, "VARCHAR"), substituicoes=(2, "VARCHAR")))
def people_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pseudonyms.pseudonymised(dealt(spark, sf_dir, examples.PERSONAL), "t")
    pairs = F.array_sort(F.transform(F.map_entries("p.substituicoes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return counted(p, texto=unframed(F.col("p.texto")), substituicoes=barred(pairs))


#: Six people of each order, from long to short, whose last names are dealt by the order's keys; where they stand reaches all finders: a role, a
#: qualification, a line above a role, beside bar numbers, and two signatures side by side.
PEOPLE = ("Maximiliano Albuquerque", "Bernardina Cavalcante", "Guilhermina Fonseca", "Felisberto Moreira", "Clotilde Barros", "Otávio Prado")
LAST_NAMES = ("Lima", "Reis", "Melo", "Cruz", "Dias", "Pena", "Vale", "Leal")
LETTER = "Autor: {1}. {3}, brasileira, casada, pede com {1}.|{2}|Advogada|OAB/SP 123.456 - {4}|{5}     {6}|OAB/RJ 65.432     OAB/MG 98.765|Protocolo {key}."


def letter(people: list[str], sql: bool) -> str:
    """SQL of LETTER with these expressions for the people."""
    parts = re.split(r"[{}]", LETTER)
    quoted = lambda x: "'" + x.replace("|", "' || chr(10) || '") + "'"
    if sql:  # what stands there afterwards
        parts = [re.sub(r"OAB/[A-Z]{2} [\d.]+", "[OAB]", x) for x in parts]
    return " || ".join(quoted(x) if i % 2 == 0 else "CAST(o_orderkey AS VARCHAR(20))" if x == "key" else people[int(x) - 1] for i, x in enumerate(parts))


@query(f"SELECT o_orderkey, md5({letter([f"'[PESSOA_{i}]'" for i in range(1, 7)], True)}) AS texto, 'OAB=3|PESSOA=7' AS substituicoes FROM orders")
def people_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several people and signatures in each text, tagged from the longest name to the shortest."""
    last = lambda i: f"element_at(array({', '.join(map(repr, LAST_NAMES))}), CAST((o_orderkey + {i} * o_custkey) % {len(LAST_NAMES)} AS INT) + 1)"
    people = [f"'{name} ' || {last(i)}" for i, name in enumerate(PEOPLE)]
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("t", F.expr(letter(people, False)))
    p = pseudonyms.pseudonymised(o, "t")
    pairs = F.array_sort(F.transform(F.map_entries("p.substituicoes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return p.select("o_orderkey", F.md5("p.texto").alias("texto"), barred(pairs).alias("substituicoes"))


@query("SELECT tipo, sum(m)::BIGINT AS n FROM (SELECT split_part(e, '=', 1) AS tipo, split_part(e, '=', 2)::INTEGER AS m FROM (SELECT unnest(string_split(r, '|')) AS e FROM orders JOIN (VALUES " + ", ".join(f"({k}, '{row[2]}')" for k, row in enumerate(examples.PERSONAL)) + f") x(k, r) ON o_orderkey % {len(examples.PERSONAL)} = k) WHERE e <> '') GROUP BY 1")
def replacements_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pseudonyms.pseudonymised(dealt(spark, sf_dir, examples.PERSONAL), "t").select(F.col("p.substituicoes").alias("s"))
    return p.select(F.explode("s").alias("tipo", "m")).groupBy("tipo").agg(F.sum("m").cast("long").alias("n"))


@query(f"SELECT k, 0::BIGINT AS sobra, count(*) AS n FROM (SELECT o_orderkey % {len(examples.PERSONAL)} AS k FROM orders) GROUP BY 1")
def masks_leave_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pseudonyms.mask(dealt(spark, sf_dir, examples.PERSONAL), "t")
    return counted(m, sobra=F.size(pseudonyms.residue(F.col("masked"))).cast("long"))


@query(expected(examples.MOVEMENTS, resultado=(2, "VARCHAR")))
def movements_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dealt(spark, sf_dir, examples.MOVEMENTS, None)
    return counted(m, resultado=movements.of_movement(F.col("t.c0"), F.col("t.c1")))


@query(expected(examples.HISTORIES, resultado=(1, "VARCHAR"), data=(2, "VARCHAR")))
def first_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda x: F.struct(F.split_part(x, F.lit("@"), F.lit(1)).try_cast("int").alias("codigo"), F.lit(None).cast("string").alias("nome"), F.nullif(F.split_part(x, F.lit("@"), F.lit(2)), F.lit("")).alias("dataHora"))
    m = dealt(spark, sf_dir, examples.HISTORIES, frame=False).withColumn("j", movements.first_judgement(F.transform(F.split("t", r"\|"), one)))
    return counted(m, resultado=F.col("j.resultado"), data=F.col("j.data"))


@query(expected(examples.ARGUED, frases=(1, "VARCHAR")))
def argumentative_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(dealt(spark, sf_dir, examples.ARGUED, frame=False), frases=barred(text.arguments(F.col("t"))))


@query(expected(examples.TERMED, termos=(1, "VARCHAR")))
def legal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dealt(spark, sf_dir, examples.TERMED, frame=False).withColumn("m", F.map_entries(text.term_counts(F.col("t"))))
    return counted(t, termos=barred(F.array_sort(F.transform("m", lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))))


@query(expected(examples.DATES, data=(1, "VARCHAR")))
def dates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(dealt(spark, sf_dir, examples.DATES, frame=False), data=text.any_date(F.col("t")).cast("string"))


@query(expected(examples.SUBJECTS, nomes=(1, "VARCHAR")))
def subjects_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(dealt(spark, sf_dir, examples.SUBJECTS, frame=False), nomes=barred(convert.subjects(F.col("t"))["nome"]))


@query(expected(examples.NUMBERED, numero=(1, "VARCHAR"), tribunal=(2, "VARCHAR")))
def case_numbers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(courts.case_numbers(F.col("t")), F.lit(0))
    return counted(dealt(spark, sf_dir, examples.NUMBERED, frame=False), numero=first, tribunal=courts.court_of_number(first))


# Courts, branches and degrees.

_STATES = "['ac', 'al', 'am', 'ap', 'ba', 'ce', 'df', 'es', 'go', 'ma', 'mg', 'ms', 'mt', 'pa', 'pb', 'pe', 'pi', 'pr', 'rj', 'rn', 'ro', 'rr', 'rs', 'sc', 'se', 'sp', 'to']"
_COURTS = f"""c AS (SELECT unnest(['stj', 'tst', 'tse', 'stm']) AS tribunal, 'superior' AS ramo UNION ALL SELECT 'trf' || i, 'federal' FROM range(1, 7) t(i) UNION ALL SELECT 'trt' || i, 'trabalho' FROM range(1, 25) t(i)
UNION ALL SELECT unnest(['tjmmg', 'tjmrs', 'tjmsp']), 'militar' UNION ALL SELECT CASE s WHEN 'df' THEN 'tjdft' ELSE 'tj' || s END, 'estadual' FROM (SELECT unnest({_STATES}) AS s) UNION ALL SELECT CASE s WHEN 'df' THEN 'tre-dft' ELSE 'tre-' || s END, 'eleitoral' FROM (SELECT unnest({_STATES}) AS s))"""


@query(f"WITH {_COURTS} SELECT tribunal, ramo FROM c")
def court_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return courts.dimension(spark).select("tribunal", "ramo")


_DEGREES = ("G1", "je", "G2", "TR", "SUP", "STJ", "x")


def court_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units of the 91 courts by key, with degree and class."""
    names = F.array(*map(F.lit, [*sorted(courts.COURTS), "nenhum"]))
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "procedente").when(F.col("o_orderstatus") == "P", "provido").otherwise("improcedente")
    degree = F.get(F.array(*map(F.lit, _DEGREES)), (F.col("o_orderkey") % len(_DEGREES)).cast("int"))
    return o.select("o_orderkey", F.get(names, (F.col("o_orderkey") % 92).cast("int")).alias("tribunal"), degree.alias("grau"), F.col("o_orderpriority").alias("classe_nome"), outcome.alias("resultado"))


_UNITS = f"""WITH {_COURTS}, k AS (SELECT tribunal, ramo, row_number() OVER (ORDER BY tribunal COLLATE "C") - 1 AS i FROM c), u AS (SELECT o_orderkey, coalesce(ramo, 'desconhecido') AS ramo, list_extract([{', '.join(f"'{d}'" for d in _DEGREES)}], (o_orderkey % {len(_DEGREES)} + 1)::BIGINT) AS grau, o_orderpriority AS classe,
CASE o_orderstatus WHEN 'F' THEN 'procedente' WHEN 'P' THEN 'provido' ELSE 'improcedente' END AS resultado FROM orders LEFT JOIN k ON o_orderkey % 92 = i)"""


def _grouped_rates(key: str) -> str:
    return f"{_UNITS} SELECT {key} AS grupo, count(*) AS total, count_if(resultado <> 'provido')::BIGINT AS merito, count_if(resultado = 'provido')::BIGINT AS recursos FROM u GROUP BY 1 HAVING count_if(resultado <> 'provido') >= 10 OR count_if(resultado = 'provido') >= 10"


@query(_grouped_rates("ramo").replace(' COLLATE "C"', ""))
def rates_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.rates(court_units(spark, sf_dir), "ramo").select("grupo", "total", "merito", "recursos")


@query(_grouped_rates("grau").replace(' COLLATE "C"', ""))
def rates_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.rates(court_units(spark, sf_dir), "grau").select("grupo", "total", "merito", "recursos")


@query(_grouped_rates("classe").replace(' COLLATE "C"', ""))
def rates_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.rates(court_units(spark, sf_dir), "classe").select("grupo", "total", "merito", "recursos")


@query(f"{_UNITS} SELECT CASE WHEN upper(grau) IN ('G1', 'JE') THEN '1' WHEN upper(grau) IN ('G2', 'TR') THEN '2' WHEN upper(grau) IN ('SUP', 'STJ') THEN '3' END AS instancia, count(*) AS n FROM u GROUP BY 1".replace(' COLLATE "C"', ""))
def instances_of_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court_units(spark, sf_dir).groupBy(consolidate.instance_of_degree(F.col("grau")).alias("instancia")).agg(F.count("*").alias("n"))


# Source records.


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of the case index: every seventh is secret, every fifth is of a sensitive class."""
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    code = F.when(F.col("o_orderstatus") == "F", 219).when(F.col("o_orderstatus") == "P", 221).otherwise(220)
    judged = F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 400).cast("int"))
    source = F.struct(
        F.col("o_orderkey").cast("string").alias("numeroProcesso"), F.struct(F.lit(7).alias("codigo"), F.when(F.col("o_orderkey") % 5 == 0, "Guarda de Família").otherwise("Procedimento Comum").alias("nome")).alias("classe"),
        F.lit("G1").alias("grau"), F.date_format("o_orderdate", "yyyyMMdd'000000'").alias("dataAjuizamento"), F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0).alias("nivelSigilo"),
        F.array(F.struct(F.lit(26).alias("codigo"), F.lit("Distribuição").alias("nome"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dataHora")), F.struct(code.alias("codigo"), F.lit("x").alias("nome"), F.date_format(judged, "yyyy-MM-dd").alias("dataHora"))).alias("movimentos"),
    )
    return o.select(F.lit("tjsp").alias("tribunal"), F.lit(None).cast("string").alias("cursor"), F.lit("x").alias("proveniencia"), F.to_json(F.struct(source.alias("_source"))).alias("hit"))


CASES_SQL = """SELECT o_orderkey::VARCHAR AS numero, o_orderdate::DATE::VARCHAR AS ajuizamento, (o_orderdate::DATE + (o_custkey % 400)::INTEGER)::VARCHAR AS julgamento, (o_custkey % 400)::INTEGER AS dias,
CASE o_orderstatus WHEN 'F' THEN 'procedente' WHEN 'P' THEN 'parcialmente_procedente' ELSE 'improcedente' END AS resultado, o_orderkey % 5 = 0 AS sensivel FROM orders WHERE o_orderkey % 7 <> 0"""


@query(CASES_SQL)
def cases_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hits to the case table: secret ones are dropped, sensitive ones marked."""
    return _converted(convert.cases(raw_hits(spark, sf_dir)))


def _converted(cases: DataFrame) -> DataFrame:
    return cases.select("numero", F.col("data_ajuizamento").cast("string").alias("ajuizamento"), F.col("data_julgamento").cast("string").alias("julgamento"), F.col("duracao_dias").cast("int").alias("dias"), "resultado", "sensivel")


#: A filing period, both ends included.
SINCE, UNTIL = "1994-03-01", "1997-06-30"


@query(f"SELECT * FROM ({CASES_SQL}) WHERE ajuizamento BETWEEN '{SINCE}' AND '{UNTIL}'")
def cases_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only cases filed within the job's period."""
    q = CaseQuery(ajuizamento_desde=date.fromisoformat(SINCE), ajuizamento_ate=date.fromisoformat(UNTIL))
    return _converted(convert.cases(raw_hits(spark, sf_dir), q))


@query("SELECT 'djen:' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'procedente' ELSE 'improcedente' END AS resultado, 'Ante o exposto, julgo ' || CASE o_orderstatus WHEN 'F' THEN 'procedente' ELSE 'improcedente' END || ' o pedido de [PESSOA_1].' AS texto, o_orderdate::DATE::VARCHAR AS data, 1 AS pessoas FROM orders WHERE o_orderkey % 3 = 0")
def notices_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw notices to the document table: only sentences are wanted, HTML goes, the addressee becomes a pseudonym."""
    from tabelion.sources.config import NoticeQuery

    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    word = F.when(F.col("o_orderstatus") == "F", "procedente").otherwise("improcedente")
    notice = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("<p>Ante o exposto,&nbsp;julgo "), word, F.lit(" o pedido de Ana Souza.</p>")).alias("texto"), F.when(F.col("o_orderkey") % 3 == 0, "Sentença").otherwise("Despacho").alias("tipoDocumento"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_disponibilizacao"), F.array(F.struct(F.lit("Ana Souza").alias("nome"))).alias("destinatarios"),
    )
    raw = o.select(F.lit("tjsp").alias("tribunal"), F.lit("x").alias("proveniencia"), F.to_json(notice).alias("hit"))
    found = convert.notices(raw, NoticeQuery(tipos_documento=["sentenca"]))
    return found.select("id", "resultado", F.btrim("texto", F.lit(" \n")).alias("texto"), F.col("data").cast("string").alias("data"), F.col("substituicoes")["PESSOA"].alias("pessoas"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id)).event_id AS event_id FROM (SELECT user_id, event_type, ts, event_id FROM events) GROUP BY 1".replace("max((ts, event_id)).event_id", "arg_max(event_id, (ts, event_id))"))
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins: what an upsert keeps of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("arrived"))
    return consolidate.latest(e, ["user_id"], "arrived").select("user_id", "event_type", "event_id")


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10))) AS plain FROM documents")
def tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.tidy(F.col("text")).cast("binary")).alias("plain"))


@query("SELECT doc_id, sha256(text) AS impressao FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("impressao"))


@query("SELECT event_id, regexp_replace(props, '[^0-9]', '', 'g') AS digitos, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, ''), props) AS primeiro, contains(lower(event_type), 'sign') OR contains(lower(event_type), 'error') AS desejado FROM events")
def first_given_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("a", F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")))
    return e.select("event_id", text.digits(F.col("props")).alias("digitos"), text.first_given(F.col("a"), F.col("props")).alias("primeiro"), convert.wanted_type(F.col("event_type"), ["Sígn", "ERROR"]).alias("desejado"))


# Chapters, samples, instances, sides.

_OBJECTS = ", ".join(f"({k}, {sql_value(objects)})" for k, objects in enumerate(row[1] for row in examples.CHAPTERS))


@query(f"SELECT objeto, resultado, forca, count(*) AS n FROM (SELECT split_part(c, '/', 1) AS objeto, split_part(c, '/', 2) AS resultado, split_part(c, '/', 3) AS forca FROM (SELECT unnest(string_split(cs, '|')) AS c FROM orders JOIN (VALUES {_OBJECTS}) e(k, cs) ON o_orderkey % {len(examples.CHAPTERS)} = k)) GROUP BY ALL")
def chapters_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command is about, in text order, and whether its rule is a strong one."""
    e = dealt(spark, sf_dir, examples.CHAPTERS).select(decisions.evaluation(F.col("t"), whole=False).alias("e"))
    return e.select(F.inline("e.capitulos")).groupBy("objeto", "resultado", "forca").agg(F.count("*").alias("n"))


_REFERENCES = ", ".join(f"({k}, {sql_value(r)})" for k, (_, r) in enumerate(examples.CITED))


@query(f"""WITH d AS (SELECT o_orderkey, o_orderstatus = 'F' AS good, r FROM orders JOIN (VALUES {_REFERENCES}) e(k, r) ON o_orderkey % {len(examples.CITED)} = k), t AS (SELECT count_if(good) AS ga, count_if(NOT good) AS gr FROM d),
c AS (SELECT good, unnest(list_distinct(list_filter(string_split(r, '|'), lambda x: x <> ''))) AS citacao FROM d)
SELECT citacao, count(*) AS documentos, round(count_if(good) / any_value(ga), 6) AS em_acolhidos, round(count_if(NOT good) / any_value(gr), 6) AS em_rejeitados FROM c, t GROUP BY 1 HAVING count(*) >= 10 ORDER BY documentos DESC, citacao LIMIT 30""")
def citations_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "procedente").otherwise("improcedente").alias("resultado"))
    d = dealt(spark, sf_dir, examples.CITED).withColumn("r", citations.cited(F.col("t"))["referencia"]).join(status, "o_orderkey")
    return measures.shares_by_side(d, "r", key="o_orderkey").select("citacao", "documentos", *(F.round(c, 6).alias(c) for c in ("em_acolhidos", "em_rejeitados")))


_KINDS = ("sentenca", "acordao", "decisao_monocratica", "embargos_declaracao", "outro")


@query(f"""SELECT CASE k WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '2' WHEN 4 THEN CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'P' THEN '2' END END AS instancia, count(*) AS n
FROM (SELECT o_orderkey % {len(_KINDS)} AS k, o_orderstatus FROM orders) GROUP BY 1""")
def instances_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS)).cast("int"))
    outcome = F.when(F.col("o_orderstatus") == "F", "procedente").when(F.col("o_orderstatus") == "P", "nao_provido").otherwise("indeterminado")
    return o.groupBy(consolidate.instance_of_document(kind, outcome).alias("instancia")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(count_if(manual = automatico) / count(*), 6) AS acuracia FROM (SELECT CASE quality WHEN 1 THEN 'procedente' ELSE 'improcedente' END AS manual, CASE WHEN n_chars > 1000 THEN 'procedente' ELSE 'improcedente' END AS automatico FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0)")
def reviewed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed sample: labels in any case, with blanks around; rows that nobody labelled (every third) don't count."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    manual = F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("quality") == 1, " Procedente ").otherwise("IMPROCEDENTE")
    rows = d.select(manual.alias("resultado_manual"), F.when(F.col("n_chars") > 1000, "procedente").otherwise("improcedente").alias("resultado_automatico"))
    return validate.accuracy(validate.confusion(validate.labelled(rows))).select("n", F.round("acuracia", 6).alias("acuracia"))


@query(f"WITH {_COURTS} SELECT tribunal FROM c WHERE ramo = 'federal' OR tribunal IN ('tjsp', 'stj')")
def courts_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return courts.dimension(spark).join(spark.createDataFrame([(c,) for c in courts.select(["federal", " TJSP", "stj", "trf1"])], "tribunal string"), "tribunal").select("tribunal")


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type = 'error') GROUP BY 1 HAVING count(*) >= 10")
def public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive rows are left out, small groups suppressed."""
    e = table(spark, sf_dir, "events").withColumn("sensivel", F.col("event_type") == "error")
    return policy.publishable(Corpus._public(e, False).groupBy("event_type").agg(F.count("*").alias("n")))


_HISTORY = ", ".join(f"({k}, {sql_value(r)})" for k, (_, r, _) in enumerate(examples.HISTORIES))


@query(f"""WITH d AS (SELECT o_custkey::VARCHAR AS numero, arg_min(CASE o_orderstatus WHEN 'F' THEN 'procedente' WHEN 'P' THEN 'indeterminado' ELSE 'improcedente' END, (o_orderstatus = 'P', o_orderdate::DATE::VARCHAR, o_orderkey::VARCHAR)) AS said FROM orders GROUP BY 1),
c AS (SELECT c_custkey::VARCHAR AS numero, r AS moved FROM customer JOIN (VALUES {_HISTORY}) e(k, r) ON c_custkey % {len(examples.HISTORIES)} = k)
SELECT numero, CASE WHEN said <> 'indeterminado' THEN said WHEN moved <> 'indeterminado' THEN moved ELSE 'indeterminado' END AS resultado, CASE WHEN said IS NULL THEN 'movimentos' WHEN moved IS NULL THEN 'texto' ELSE 'ambos' END AS fonte,
coalesce(said <> 'indeterminado' AND moved <> 'indeterminado' AND said <> moved, false) AS divergente FROM d FULL JOIN c USING (numero)""")
def texts_and_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts and customers as case records of one number: the first determined text by date, movements where it leaves the outcome open."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    said = F.when(F.col("o_orderstatus") == "F", "procedente").when(F.col("o_orderstatus") == "P", "indeterminado").otherwise("improcedente")
    none = F.lit(None).cast("string")
    evaluated = F.struct(F.lit("sentenca").alias("tipo_decisao"), F.lit("alta").alias("confianca"), none.alias("motivo"), none.alias("resultado_acao"), F.array().cast(f"array<{decisions.CHAPTER}>").alias("capitulos"))
    docs = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("x").alias("tribunal"), F.col("o_custkey").cast("string").alias("numero"), F.to_date("o_orderdate").alias("data"), F.lit("c").alias("classe_nome"), said.alias("resultado"), F.lit(False).alias("sensivel"), evaluated.alias("avaliacao"), F.lit(None).cast("struct<repeticao:string>").alias("calculo"))
    moved = F.get(F.array(*(F.lit(r) for _, r, _ in examples.HISTORIES)), (F.col("c_custkey") % len(examples.HISTORIES)).cast("int"))
    cases = c.select(F.lit("x").alias("tribunal"), F.col("c_custkey").cast("string").alias("numero"), F.lit("G1").alias("grau"), F.lit("c").alias("classe_nome"), F.array().cast("array<struct<codigo:int,nome:string>>").alias("assuntos"), F.lit(None).cast("date").alias("data_ajuizamento"), F.lit(None).cast("date").alias("data_julgamento"), F.lit(None).cast("int").alias("duracao_dias"), moved.alias("resultado"), F.lit(False).alias("sensivel"))
    return consolidate.consolidate(cases, docs).select("numero", "resultado", "fonte", F.coalesce("divergente", F.lit(False)).alias("divergente"))

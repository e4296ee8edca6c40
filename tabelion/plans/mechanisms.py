"""Registered queries of the storage, sampling and statistics mechanisms over given tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.functions import sql, stats, variants
from tabelion.operators import measures, validate
from tabelion.plans.analytics import _UNITS, _wilson, units
from tabelion.plans.registry import query, table
from tabelion.session import shared_dir
from tabelion.sources.corpus import Corpus

_QUANTILES = {"q10": 0.1, "q25": 0.25, "mediana": 0.5, "q90": 0.9, "maximo": 1.0}
_QUANTILE_SQL = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in _QUANTILES.items())


@query(f"SELECT 'todos' AS grupo, count(l_extendedprice) AS n, {_QUANTILE_SQL} FROM lineitem UNION ALL SELECT l_returnflag, count(l_extendedprice), {_QUANTILE_SQL} FROM lineitem GROUP BY 1")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all line items as one group, and by their flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = [stats.exact_quantiles(rows.withColumn("grupo", g), ["grupo"], "l_extendedprice", _QUANTILES) for g in (F.lit("todos"), F.col("l_returnflag"))]
    return found[0].unionByName(found[1]).select("grupo", "n", *(F.round(n, 6).alias(n) for n in _QUANTILES))


_DURATION_SQL = ", ".join(f"round(quantile_cont(d, {q}), 6) AS {n}" for n, q in (("mediana_dias", 0.5), ("q1_dias", 0.25), ("q3_dias", 0.75)))


@query(f"SELECT grupo, count(*) AS n, {_DURATION_SQL} FROM (SELECT upper(n_name) AS grupo, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE d >= 0 GROUP BY 1 HAVING count(*) >= 10")
def durations_of_huge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment by nation; negative ones don't count."""
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    cases = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    days = stats.days_between(F.to_date("o_orderdate"), F.to_date("l_shipdate"))
    found = measures.durations(cases.select(F.lower("n_name").alias("tribunal"), days.alias("duracao_dias")), "tribunal", huge=True)
    return found.select("grupo", "n", *(F.round(c, 6).alias(c) for c in ("mediana_dias", "q1_dias", "q3_dias")))


def _set_columns() -> str:
    columns = []
    for name, hits, of in (("procedencia", "f", "merito"), ("acolhimento", "g", "merito"), ("provimento", "v", "recursos")):
        for suffix, value in zip(("", "_ic_inf", "_ic_sup"), _wilson(hits, f"nullif({of}, 0)"), strict=True):
            columns.append(f"CASE WHEN {of} >= 10 THEN round({value}, 6) END AS {name}{suffix}")
    return ", ".join(columns)


@query(f"""WITH {_UNITS}, k AS (SELECT resultado, upper(tribunal) AS tribunal, 'R' || regiao AS grau, coalesce(year(data_julgamento)::VARCHAR, 'sem data') AS ano, motivo AS classe FROM u),
c AS (SELECT CASE WHEN grouping(tribunal) = 0 THEN 'tribunal' WHEN grouping(grau) = 0 THEN 'grau' WHEN grouping(ano) = 0 THEN 'ano' ELSE 'classe' END AS agrupamento, coalesce(tribunal, grau, ano, classe) AS grupo, count(*) AS total,
 count_if(resultado IN ('procedente', 'parcialmente_procedente', 'improcedente')) AS merito, 0 AS recursos, count_if(resultado = 'procedente') AS f, count_if(resultado IN ('procedente', 'parcialmente_procedente')) AS g, 0 AS v
 FROM k GROUP BY GROUPING SETS ((tribunal), (grau), (ano), (classe)))
SELECT agrupamento, grupo, total, merito::BIGINT AS merito, recursos::BIGINT AS recursos, {_set_columns()} FROM c WHERE merito >= 10""")
def rates_of_all_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four groupings in one pass: nation, region, year and priority of the orders."""
    u = units(spark, sf_dir).withColumns({"grau": F.concat(F.lit("R"), F.col("regiao").cast("string")), "classe_nome": F.col("motivo")})
    names = [n + s for n in ("procedencia", "acolhimento", "provimento") for s in ("", "_ic_inf", "_ic_sup")]
    return measures.rates_of_all(u, ("tribunal", "grau", "ano", "classe")).select("agrupamento", "grupo", "total", "merito", "recursos", *(F.round(n, 6).alias(n) for n in names))


@query("""SELECT l_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, l_id) AS r FROM (SELECT event_id AS l_id, label, md5(event_id::VARCHAR) AS o FROM (SELECT event_id, CASE WHEN user_id % 10 < 9 THEN 'frequente' WHEN event_type = 'click' THEN NULL ELSE event_type END AS label FROM events)))
ORDER BY r > 60 // (SELECT count(DISTINCT coalesce(label, '-')) FROM (SELECT CASE WHEN user_id % 10 < 9 THEN 'frequente' WHEN event_type = 'click' THEN NULL ELSE event_type END AS label FROM events)), o, l_id LIMIT 60""")
def skewed_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine of ten events share a label; one label is null."""
    label = F.when(F.col("user_id") % 10 < 9, "frequente").when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("l_id"), label.alias("label"))
    return validate.stratified(rows, "label", 60, "l_id", F.md5(F.col("l_id").cast("string").cast("binary")))


#: What becomes of {"k": n} by kind of event: a number, a string, an object, a list, or text that is no JSON.
_DRIFT = {"purchase": '{"k":N}', "click": '{"k":"N","via":"web"}', "error": '{"k":{"v":N}}', "signup": '{"k":[N,7]}', "view": "{k:N"}
_N = "(props->>'$.k')"


@query(f"""WITH p AS (SELECT event_type, {_N}::BIGINT AS n, CASE event_type WHEN 'purchase' THEN 'OBJECT<k: BIGINT>' WHEN 'click' THEN 'OBJECT<k: STRING, via: STRING>' WHEN 'error' THEN 'OBJECT<k: OBJECT<v: BIGINT>>' WHEN 'signup' THEN 'OBJECT<k: ARRAY<BIGINT>>' END AS forma FROM events)
SELECT event_type, forma, count(*) AS n, sum(CASE WHEN event_type IN ('purchase', 'click') THEN n END)::BIGINT AS k, sum(CASE event_type WHEN 'error' THEN n END)::BIGINT AS dentro, sum(CASE event_type WHEN 'signup' THEN n END)::BIGINT AS primeiro, count_if(event_type = 'click')::BIGINT AS via
FROM p GROUP BY 1, 2""")
def drifting_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one name and many types, read by type from one parsed column, with the shape of each row kept."""
    n = F.get_json_object("props", "$.k")
    text = F.lit(None).cast("string")
    for kind, form in _DRIFT.items():
        text = F.when(F.col("event_type") == kind, F.replace(F.lit(form), F.lit("N"), n)).otherwise(text)
    e = table(spark, sf_dir, "events").select("event_type", variants.parsed(text).alias("v"))
    e = e.withColumns(variants.typed(F.col("v"), k=("$.k", "bigint"), dentro=("$.k.v", "bigint"), primeiro=("$.k[0]", "bigint"), via=("$.via", "string")))
    sums = [F.sum(c).cast("long").alias(c) for c in ("k", "dentro", "primeiro")]
    return e.groupBy("event_type", F.schema_of_variant("v").alias("forma")).agg(F.count("*").alias("n"), *sums, F.count("via").alias("via"))


_LOW, _HIGH = _wilson("f", "nullif(n, 0)")[1:]


@query(f"""SELECT lower(o_orderpriority) AS prioridade, regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digitos, n, round(f / n, 6) AS parte, round({_LOW}, 6) AS inferior, round({_HIGH}, 6) AS superior, dias
FROM (SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F')::DOUBLE AS f, max(CASE WHEN o_orderdate::DATE >= DATE '1996-01-01' THEN date_diff('day', DATE '1996-01-01', o_orderdate::DATE) END)::INTEGER AS dias FROM orders GROUP BY 1)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's functions in SQL text only."""
    sql.register(spark)
    view = f"orders_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spark.sql(f"""SELECT prioridade, digitos, n, round(p, 6) AS parte, round(a, 6) AS inferior, round(b, 6) AS superior, dias FROM (
 SELECT normalizado(o_orderpriority) AS prioridade, so_digitos(o_orderpriority) AS digitos, n, proporcao(f, n) AS p, wilson_inf(f, n) AS a, wilson_sup(f, n) AS b, dias FROM (
  SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F') AS f, max(dias_entre(DATE'1996-01-01', to_date(o_orderdate))) AS dias FROM {view} GROUP BY o_orderpriority))""")


_STATES = """SELECT o_orderkey::VARCHAR AS numero, lower(o_orderpriority[1:1]) AS tribunal, CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'G1' END AS grau,
 CASE o_orderstatus WHEN 'F' THEN 'procedente' WHEN 'P' THEN 'parcialmente_procedente' ELSE 'indeterminado' END AS resultado, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS revisto, 3 - (o_orderstatus = 'O')::INTEGER AS versoes FROM orders"""


@query(f"SELECT *, (SELECT 2 * count(*) + count_if(o_orderstatus <> 'O') FROM orders)::BIGINT AS escritas FROM ({_STATES}) WHERE tribunal <> '5'")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases through the corpus: all of them, all again with repeated keys, those that aren't open a third time with a new column; a base in between.
    What is read back is the last row of each key, without the sensitive ones (one priority)."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    base = o.select(F.col("o_orderkey").cast("string").alias("numero"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("tribunal"), F.when(status != "O", "G1").alias("grau"), F.lit("indeterminado").alias("resultado"), F.lit(1).alias("versoes"), (F.substring("o_orderpriority", 1, 1) == "5").alias("sensivel"), "o_orderstatus", F.col("o_custkey").alias("revisto"))
    corpus = Corpus(spark, f"{shared_dir(spark)}/tabelion/corpus-{uuid.uuid4().hex}", compact_after=1, bucket_rows=100_000)
    plain = ["numero", "tribunal", "grau", "resultado", "versoes", "sensivel"]
    written = corpus.upsert_cases(base.select(*plain))["rows"]
    twice = base.withColumns({"versoes": F.lit(2), "__arrived": F.lit("b")}).unionByName(base.withColumns({"resultado": F.lit("procedente"), "versoes": F.lit(0), "__arrived": F.lit("a")}))
    written += corpus.upsert_cases(twice.select(*plain, "__arrived"))["rows"]
    late = base.where(status != "O").withColumns({"resultado": F.when(status == "F", "procedente").otherwise("parcialmente_procedente"), "versoes": F.lit(3), "revisto": F.when(status == "P", F.col("revisto"))})
    written += corpus.upsert_cases(late.select(*plain, "revisto"))["rows"]
    return corpus.cases().select("numero", "tribunal", "grau", "resultado", "revisto", "versoes", F.lit(written).cast("long").alias("escritas"))

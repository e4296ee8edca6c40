"""Registered analytic queries: each operator on the given tables, and the SQL that must give the same rows.

Order status stands for an outcome (F granted, P granted in part, O denied), orders for units, nations for courts, documents
with labels for texts. Fractions are rounded to six places on both sides, as sums are added in another order there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabelion.functions import courts, movements, policy, stats, text
from tabelion.operators import consolidate, decisions, measures, paging, pseudonyms, validate
from tabelion.plans.registry import query, table
from tabelion.sources import corpus

def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def outcome(status: Column) -> Column:
    return F.when(status == "F", "procedente").when(status == "P", "parcialmente_procedente").when(status == "O", "improcedente").otherwise("indeterminado")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as first-instance units of the customer's nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("numero"), F.lit("1").alias("instancia"), outcome(F.col("o_orderstatus")).alias("resultado"),
        F.lower("n_name").alias("tribunal"), F.to_date("o_orderdate").alias("data_julgamento"), F.col("o_orderpriority").alias("motivo"), F.col("o_totalprice").alias("valor"), F.col("n_regionkey").alias("regiao"),
    )


_OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'procedente' WHEN 'P' THEN 'parcialmente_procedente' WHEN 'O' THEN 'improcedente' ELSE 'indeterminado' END"
_UNITS = f"u AS (SELECT o_orderkey AS id, {_OUTCOME} AS resultado, lower(n_name) AS tribunal, o_orderdate::DATE AS data_julgamento, o_orderpriority AS motivo, n_regionkey AS regiao FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"


def _wilson(hits: str, n: str) -> tuple[str, str, str]:
    p, z = f"({hits}::DOUBLE / {n})", 1.96
    centre = f"({p} + {z * z} / (2 * {n}::DOUBLE)) / (1 + {z * z} / {n})"
    margin = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n}::DOUBLE * {n})) / (1 + {z * z} / {n})"
    return p, f"greatest(0, {centre} - {margin})", f"least(1, {centre} + {margin})"


def _rates(group: str) -> str:
    columns = []
    for name, hits, of in (("procedencia", "f", "merito"), ("acolhimento", "g", "merito"), ("provimento", "v", "recursos")):
        for suffix, value in zip(("", "_ic_inf", "_ic_sup"), _wilson(hits, f"nullif({of}, 0)"), strict=True):
            columns.append(f"CASE WHEN {of} >= 10 THEN round({value}, 6) END AS {name}{suffix}")
    return f"""WITH {_UNITS}, c AS (SELECT {group} AS grupo, count(*) AS total, count_if(resultado IN ('procedente', 'parcialmente_procedente', 'improcedente')) AS merito,
 count_if(resultado IN ('provido', 'parcialmente_provido', 'nao_provido')) AS recursos, count_if(resultado = 'procedente') AS f,
 count_if(resultado IN ('procedente', 'parcialmente_procedente')) AS g, count_if(resultado IN ('provido', 'parcialmente_provido')) AS v FROM u GROUP BY 1)
SELECT grupo, total, merito::BIGINT AS merito, recursos::BIGINT AS recursos, {", ".join(columns)} FROM c WHERE merito >= 10 OR recursos >= 10"""


_RATE_COLUMNS = [n + s for n in ("procedencia", "acolhimento", "provimento") for s in ("", "_ic_inf", "_ic_sup")]


def _rated(df: DataFrame, by: str | Column) -> DataFrame:
    return measures.rates(df, by).select("grupo", "total", "merito", "recursos", *r6(*_RATE_COLUMNS))


@query(_rates("upper(coalesce(nullif(tribunal, ''), 'desconhecido'))"))
def rates_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(units(spark, sf_dir), "tribunal")


@query(_rates("strftime(data_julgamento, '%Y')"))
def rates_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(units(spark, sf_dir), "ano")


@query(f"WITH {_UNITS}{_rates('x')[len('WITH ' + _UNITS) :]}".replace("SELECT x AS grupo", "SELECT coalesce(r_name, 'desconhecido') AS grupo").replace("FROM u GROUP BY 1", "FROM u LEFT JOIN region ON regiao = r_regionkey GROUP BY 1"))
def rates_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = units(spark, sf_dir).join(table(spark, sf_dir, "region"), F.col("regiao") == F.col("r_regionkey"), "left")
    return _rated(joined, F.coalesce("r_name", F.lit("desconhecido")))


@query(f"SELECT {_OUTCOME} AS resultado, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proporcao FROM orders GROUP BY 1")
def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.distribution(table(spark, sf_dir, "orders").select(outcome(F.col("o_orderstatus")).alias("resultado")))
    return found.select("resultado", "n", *r6("proporcao"))


_NATIONAL = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS medida, sum(n)::BIGINT AS n, round({_wilson("sum(h)", "sum(n)")[0]}, 6) AS agregada, round({_wilson("sum(h)", "sum(n)")[1]}, 6) AS agregada_ic_inf, round({_wilson("sum(h)", "sum(n)")[2]}, 6) AS agregada_ic_sup,
 count(r) AS tribunais, round(avg(r), 6) AS media_tribunais, round(min(r), 6) AS minimo_tribunais, round(max(r), 6) AS maximo_tribunais
FROM (SELECT *, CASE WHEN n >= 10 THEN h::DOUBLE / n END AS r FROM (SELECT tribunal, count(*) AS n, count_if(resultado IN ({hits})) AS h FROM u WHERE resultado IN ({of}) GROUP BY 1)) HAVING sum(n) >= 10"""
    for name, of, hits in (("procedência", "'procedente', 'parcialmente_procedente', 'improcedente'", "'procedente'"), ("acolhimento", "'procedente', 'parcialmente_procedente', 'improcedente'", "'procedente', 'parcialmente_procedente'"), ("provimento", "'provido', 'parcialmente_provido', 'nao_provido'", "'provido', 'parcialmente_provido'"))
)


@query(f"WITH {_UNITS} {_NATIONAL}")
def pooled_and_mean_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures.national_rates(units(spark, sf_dir))
    return found.select("medida", "n", *r6("agregada", "agregada_ic_inf", "agregada_ic_sup"), "tribunais", *r6("media_tribunais", "minimo_tribunais", "maximo_tribunais"))


@query("""SELECT o_orderpriority AS grupo, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS mediana_dias, round(quantile_cont(d, 0.25), 6) AS q1_dias, round(quantile_cont(d, 0.75), 6) AS q3_dias
FROM (SELECT o_orderpriority, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE d >= 0 GROUP BY 1 HAVING count(*) >= 10""")
def duration_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select("o_orderpriority", stats.days_between(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("duracao_dias"))
    return measures.durations(rows, F.col("o_orderpriority")).select("grupo", "n", *r6("mediana_dias", "q1_dias", "q3_dias"))


_AMOUNTS = f"""WITH {_UNITS}, f AS (SELECT l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT upper(tribunal) AS grupo, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS mediana, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3
FROM u JOIN f ON l_orderkey = id WHERE resultado IN ('procedente', 'parcialmente_procedente') AND v BETWEEN 1 AND 10000000 GROUP BY 1 HAVING count(*) >= 10"""


@query(_AMOUNTS)
def amount_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by("l_extendedprice", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    firsts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(first.alias("v"))
    calculation = F.struct(F.array(F.struct(F.lit("danos_morais").alias("categoria"), F.col("v").alias("valor"))).alias("valores"))
    return measures.award_amounts(units(spark, sf_dir).join(firsts, "id").withColumn("calculo", calculation)).select("grupo", "n", *r6("mediana", "q1", "q3"))


@query("""SELECT parametro, valor, n, round(share, 6) AS proporcao FROM (SELECT *, n / sum(n) OVER (PARTITION BY parametro) AS share FROM (
SELECT parametro, valor, count(*) AS n FROM (SELECT 'flag' AS parametro, l_returnflag AS valor FROM lineitem UNION ALL SELECT 'status', l_linestatus FROM lineitem UNION ALL SELECT 'priority', o_orderpriority FROM orders) GROUP BY 1, 2)) WHERE n >= 10""")
def parameter_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(k).alias("parametro"), F.col(c).alias("valor")) for k, c in (("flag", "l_returnflag"), ("status", "l_linestatus"))))
    long = table(spark, sf_dir, "lineitem").select(F.inline(cells)).union(table(spark, sf_dir, "orders").select(F.lit("priority"), "o_orderpriority"))
    return measures.shares_within(long).select("parametro", "valor", "n", *r6("proporcao"))


@query("SELECT coalesce(nullif(event_type, ''), 'não identificado') AS motivo, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proporcao FROM events GROUP BY 1")
def reason_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("extinto_sem_merito").alias("resultado"), F.lit("texto").alias("fonte_resultado"), F.col("event_type").alias("motivo"))
    return measures.reasons(e).select("motivo", "n", *r6("proporcao"))


_FIRSTS = """WITH a AS (SELECT user_id, min((ts, event_id)) AS k FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, min((ts, event_id)) AS k FROM events WHERE event_type = 'error' GROUP BY 1)"""


@query(_FIRSTS + """ SELECT coalesce(a.user_id, b.user_id)::VARCHAR AS numero, CASE WHEN a.user_id IS NULL THEN 'movimentos' WHEN b.user_id IS NULL THEN 'texto' ELSE 'ambos' END AS fonte,
CASE WHEN a.user_id IS NULL THEN 'improcedente' ELSE 'procedente' END AS resultado, a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS divergente FROM a FULL JOIN b ON a.user_id = b.user_id""")
def consolidated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as texts and errors as movements of a user's case."""
    e = table(spark, sf_dir, "events")
    docs = e.where("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("id"), F.lit("x").alias("tribunal"), F.col("user_id").cast("string").alias("numero"), F.col("ts").alias("data"), F.lit("c").alias("classe_nome"), F.lit("procedente").alias("resultado"), F.lit(False).alias("sensivel"),
        F.struct(F.lit("sentenca").alias("tipo_decisao"), F.lit("alta").alias("confianca"), F.lit(None).cast("string").alias("motivo"), F.lit(None).cast("string").alias("resultado_acao"), F.array().cast(f"array<{decisions.CHAPTER}>").alias("capitulos")).alias("avaliacao"),
        F.lit(None).cast("struct<repeticao:string>").alias("calculo"),
    )
    cases = e.where("event_type = 'error'").select(
        F.lit("x").alias("tribunal"), F.col("user_id").cast("string").alias("numero"), F.lit("G1").alias("grau"), F.lit("c").alias("classe_nome"), F.array().cast("array<struct<codigo:int,nome:string>>").alias("assuntos"),
        F.lit(None).cast("date").alias("data_ajuizamento"), F.col("ts").alias("data_julgamento"), F.lit(None).cast("int").alias("duracao_dias"), F.lit("improcedente").alias("resultado"), F.lit(False).alias("sensivel"),
    )
    return consolidate.consolidate(cases, docs).select("numero", "fonte", "resultado", "divergente")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min(ts) AS ts FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def first_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    return consolidate.first_rows(e, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "ts")


_PAIRS = f"""WITH o AS (SELECT o_custkey, o_orderstatus, {_OUTCOME} AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT a.r AS sentenca, CASE b.o_orderstatus WHEN 'F' THEN 'provido' WHEN 'P' THEN 'parcialmente_provido' ELSE 'nao_provido' END AS recurso FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = 2),
q AS (SELECT *, CASE WHEN recurso = 'nao_provido' THEN sentenca WHEN sentenca = 'parcialmente_procedente' THEN 'indeterminado (ambas as partes podem ter recorrido)' WHEN recurso = 'provido' THEN CASE WHEN sentenca = 'procedente' THEN 'improcedente' ELSE 'procedente' END ELSE 'parcialmente_procedente' END AS final FROM p)"""


def _appealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first order as the sentence, the second as the appeal."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("k <= 2")
    appeal = F.when(F.col("o_orderstatus") == "F", "provido").when(F.col("o_orderstatus") == "P", "parcialmente_provido").otherwise("nao_provido")
    rows = o.select(F.col("o_custkey").cast("string").alias("numero"), F.col("k").cast("string").alias("instancia"), F.when(F.col("k") == 1, outcome(F.col("o_orderstatus"))).otherwise(appeal).alias("resultado"), F.lit(None).cast("string").alias("resultado_acao"), F.lit(None).cast("string").alias("motivo"))
    return measures.appealed(rows)


@query(_PAIRS + " SELECT sentenca, recurso, count(*) AS n FROM q GROUP BY 1, 2")
def reversal_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.cross_table(_appealed(spark, sf_dir), "sentenca", "recurso")


@query(_PAIRS + " SELECT sentenca, final, count(*) AS n FROM q GROUP BY 1, 2")
def final_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.cross_table(_appealed(spark, sf_dir), "sentenca", "final")


@query(_PAIRS + " SELECT count(*) AS pares, round(count_if(recurso <> 'nao_provido') / count(*), 6) AS taxa_reforma FROM q")
def reversal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.reversal_rate(_appealed(spark, sf_dir)).select("pares", *r6("taxa_reforma"))


_W = _wilson("h", "n")


@query(f"SELECT n AS recursos, round({_W[0]}, 6) AS provimento, round({_W[1]}, 6) AS ic_inf, round({_W[2]}, 6) AS ic_sup FROM (SELECT count(*) AS n, count_if(l_returnflag = 'A')::BIGINT AS h FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'O')")
def appeals_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as the chapters of a decision; open lines are strong, A is won and N lost."""
    won = F.when(F.col("l_returnflag") == "A", "provido").when(F.col("l_returnflag") == "N", "nao_provido").otherwise("nao_conhecido")
    chapter = F.struct(won.alias("resultado"), F.lit("recurso").alias("objeto"), F.when(F.col("l_linestatus") == "O", "forte").otherwise("fraca").alias("forca"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(chapter).alias("capitulos"))
    return measures.reversals_by_appeal(rows).select("recursos", *r6("provimento", "ic_inf", "ic_sup"))


@query(f"""WITH s AS (SELECT {_OUTCOME} AS resultado, unnest(CASE WHEN o_totalprice < 1000 THEN ['não informado'] WHEN o_totalprice < 200000 THEN [o_orderpriority] ELSE [o_orderpriority, o_orderstatus] END) AS grupo FROM orders)
SELECT grupo, count(*) AS total, count_if(resultado IN ('procedente', 'parcialmente_procedente', 'improcedente'))::BIGINT AS merito FROM s GROUP BY 1 HAVING count_if(resultado IN ('procedente', 'parcialmente_procedente', 'improcedente')) >= 10""")
def multi_key_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = lambda name: F.struct(F.lit(1).alias("codigo"), F.col(name).alias("nome"))
    none = F.array().cast("array<struct<codigo:int,nome:string>>")
    listed = F.when(F.col("o_totalprice") < 1000, none).when(F.col("o_totalprice") < 200000, F.array(subject("o_orderpriority"))).otherwise(F.array(subject("o_orderpriority"), subject("o_orderstatus")))
    return measures.rates(table(spark, sf_dir, "orders").select(outcome(F.col("o_orderstatus")).alias("resultado"), listed.alias("assuntos")), "assunto").select("grupo", "total", "merito")


@query("""SELECT (SELECT count(*) FROM orders) AS processos, (SELECT count(*) FROM customer) AS documentos, (SELECT count(*) FROM (SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer)) AS tribunais,
(SELECT sum(CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END + c_nationkey)::BIGINT FROM customer) AS substituicoes""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases and customers as documents, of the courts named by priority and segment."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tribunal"))
    replaced = F.create_map(F.lit("CPF"), F.when(F.col("c_acctbal") > 0, 2).otherwise(0), F.lit("PESSOA"), F.col("c_nationkey"))
    return corpus.totals(cases, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tribunal"), replaced.alias("substituicoes")))


@query("SELECT count(*) AS unidades, count_if(event_type = 'error')::BIGINT AS indeterminadas, count_if(event_id % 3 = 0)::BIGINT AS com_duas_fontes, count_if(event_id % 3 = 0 AND value > 50)::BIGINT AS divergentes FROM events")
def quality_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "indeterminado").otherwise("procedente").alias("resultado"), F.lit("alta").alias("confianca"), F.when(F.col("event_id") % 3 == 0, "ambos").otherwise("texto").alias("fonte"), (F.col("value") > 50).alias("divergente"))
    return measures.quality(e).select("unidades", "indeterminadas", "com_duas_fontes", "divergentes")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of good and bad quality as granting and denying documents."""
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").join(good, "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "procedente").otherwise("improcedente").alias("resultado"))


_ACCENTS = text._FROM, text._TO
_STOPS = ", ".join(f"'{w}'" for w in sorted({*text.STOP_WORDS, *text.COURT_NOISE}))
_NOT_VOCABULARY = ", ".join(f"'{w}'" for w in measures.NOT_VOCABULARY)
_LABELLED = "d AS (SELECT doc_id, text, quality = 1 AS good FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"
_TOKENS = r"regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*')"


@query(f"""WITH {_LABELLED}, w AS (SELECT good, unnest({_TOKENS}) AS word FROM d), k AS (SELECT word, count_if(good) AS n_a, count_if(NOT good) AS n_b FROM w WHERE length(word) >= 3 AND word NOT IN ({_STOPS}) AND word NOT IN ({_NOT_VOCABULARY}) GROUP BY 1),
t AS (SELECT sum(n_a)::DOUBLE AS a, sum(n_b)::DOUBLE AS b FROM k), p AS (SELECT *, 1000.0 * (n_a + n_b) / (a + b) AS al FROM k, t WHERE n_a + n_b >= 5)
SELECT word, round((ln((n_a + al) / (a + 1000 - n_a - al)) - ln((n_b + al) / (b + 1000 - n_b - al))) / sqrt(1 / (n_a + al) + 1 / (n_b + al)), 6) AS z, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b FROM p""")
def log_odds_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.vocabulary(labelled_documents(spark, sf_dir), "text").select("word", *r6("z"), "n_a", "n_b")


@query(f"""WITH {_LABELLED}, t AS (SELECT count_if(good) AS ga, count_if(NOT good) AS gr FROM d), c AS (SELECT good, unnest(list_distinct(regexp_extract_all(text, '[0-9]+\\.[0-9]+'))) AS citacao FROM d)
SELECT citacao, count(*) AS documentos, round(count_if(good) / any_value(ga), 6) AS em_acolhidos, round(count_if(NOT good) / any_value(gr), 6) AS em_rejeitados FROM c, t GROUP BY 1 HAVING count(*) >= 2 ORDER BY documentos DESC, citacao LIMIT 30""")
def citation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled_documents(spark, sf_dir).withColumn("refs", F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0)))
    return measures.shares_by_side(docs, "refs", least=2).select("citacao", "documentos", *r6("em_acolhidos", "em_rejeitados"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter({_TOKENS}, lambda x: length(x) >= 3 AND NOT list_contains([{_STOPS}], x)) AS t FROM documents)")
def telling_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.telling_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM documents) WHERE length(word) >= 3 AND word NOT IN ({_STOPS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.telling_tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


_TERMS = ("the", "of the", "license", "idiot", "être", "el que")


@query("SELECT term, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS term, len(regexp_extract_all(regexp_replace(translate(lower(text), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '\\s+', ' ', 'g'), '\\b{t.translate(str.maketrans(*_ACCENTS))}\\b')) AS n FROM documents" for t in _TERMS) + ") GROUP BY 1 HAVING sum(n) > 0")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(text.term_counts(F.col("text"), _TERMS)).alias("term", "k")).groupBy("term").agg(F.sum("k").cast("long").alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'))) AS plain FROM documents")
def unaccent_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded(F.col("text")).cast("binary")).alias("plain"))


_MARK = "chr(1)"


@query(f"""SELECT conv_id, turn, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS frases FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '([.!?;])\\s+([A-ZÀ-Ý"“(])', '\\1' || {_MARK} || '\\2', 'g'), {_MARK}), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.sentences(F.col("text")).alias("s"))
    return s.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("frases"))


_DECODED = "regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>|</p>|</div>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _name, _char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):  # the given pages have no others
    _DECODED = f"replace({_DECODED}, '&{_name};', '{_char}')"


@query(f"SELECT page_id, md5(array_to_string(list_transform(string_split({_DECODED}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10))) AS plain FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_to_text(F.col("html")).cast("binary")).alias("plain"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b', '[EMAIL]', 'g')) AS masked, len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b'))::BIGINT AS n FROM documents")
def emails_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, pattern = pseudonyms.DOCUMENTS[0]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", pattern, f"[{kind}]").cast("binary")).alias("masked"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("n"))


#: The document patterns for an engine without look-around: what stands before and after a match is kept, and each is
#: replaced twice, as a match may begin with what the one before it ended with.
_MASKS = (
    ("EMAIL", "", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", ""), ("CNPJ", r"[^0-9]", r"\d{2}\.?\d{3}\.?\d{3}/\d{4}-?\d{2}", r"[^0-9]"),
    ("CPF", r"[^0-9.]", r"(?:\d{3}\.\d{3}\.\d{3}-\d{2})", r"[^0-9]"), ("CPF", "", r"\bCPF[^\d\n]{0,12}\d{11}\b", ""), ("RG", "", r"(?i)\bR\.?G\.?\s*(?:n[º°o.]*)?\s*[:\-]?\s*[\dA-Z][\d.\-xX]{4,}", ""),
    ("OAB", "", r"(?i)\bOAB\s*/?\s*[A-Z]{2}\s*(?:n[º°o.]*)?\s*[:\-]?\s*\d[\d.]*[A-Z]?", ""),
    ("OAB", r"[^\w/]", r"(?:AC|AL|AM|AP|BA|CE|DF|ES|GO|MA|MG|MS|MT|PA|PB|PE|PI|PR|RJ|RN|RO|RR|RS|SC|SE|SP|TO)\d{5,6}[A-Z]?\b", ""),
    ("CEP", "", r"(?i)\bCEP\s*[:\-]?\s*\d{2}\.?\d{3}-?\d{3}\b", ""), ("CEP", r"[^0-9]", r"\d{5}-\d{3}", r"[^0-9]"), ("TELEFONE", r"[^0-9.]", r"(?:\(\d{2}\)\s*|\b\d{2}\s)?9?\d{4}-\d{4}", r"[^0-9.]"),
    ("CONTA", "", r"(?i)\b(?:ag[êe]ncia|conta(?:\s+corrente|\s+poupan[çc]a)?|c/c)\s*(?:n[º°o.]*)?\s*[:\-]?\s*\d[\d.\-xX]{2,}", ""),
    ("ENDERECO", "", r"\b(?:Rua|R\.|Avenida|Av\.|Travessa|Tv\.|Alameda|Al\.|Estrada|Rodovia|Pra[çc]a|Largo|Viela|Quadra|Setor)\s+[^,\n;]{2,60}?,?\s*(?:n[º°o.]*\s*)?\d+[A-Za-z]?(?:\s*,\s*(?:apto|apartamento|casa|bloco|sala|lote)\.?\s*\w+)*", ""),
)


def _masked() -> str:
    found = "coalesce(text, '')"
    for kind, before, pattern, after in _MASKS:
        a, b = f"(^|{before})" if before else "()", f"($|{after})" if after else "()"
        for _ in range(2 if before or after else 1):
            found = f"regexp_replace({found}, '{'(?i)' * ('(?i)' in pattern)}{a}{pattern.replace('(?i)', '')}{b}', '\\1[{kind}]\\2', 'g')"
    return found


_KINDS = ("CEP", "CNPJ", "CONTA", "CPF", "EMAIL", "ENDERECO", "OAB", "RG", "TELEFONE")
_TAGS = ", ".join(f"CASE WHEN contains(m, '[{k}]') THEN '{k}=' || ((length(m) - length(replace(m, '[{k}]', ''))) // {len(k) + 2}) END" for k in _KINDS)


@query(f"SELECT doc_id, md5(m) AS masked, array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL), '|') AS counts FROM (SELECT doc_id, {_masked()} AS m FROM documents)")
def documents_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonyms.mask(table(spark, sf_dir, "documents"), "text")
    pairs = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return d.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked"), F.array_join(pairs, "|").alias("counts"))


@query("SELECT doc_id, regexp_matches(strip_accents(lower(text[1:3000])), 'segredo de justica|tramita(?:m|ndo)? (?:sob|em) sigilo|processo sigiloso|sob sigilo') AS secreto FROM documents")
def secrecy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", policy.secret(None, F.col("text")).alias("secreto"))


@query(f"SELECT doc_id, regexp_matches(strip_accents(lower(text[1:5000])), '{policy.SENSITIVE.removeprefix('(?U)')}') AS sensivel FROM documents")
def sensitive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", policy.sensitive(F.substring("text", 1, policy.SENSITIVE_HEAD)).alias("sensivel"))


_PREDICTED = "p AS (SELECT CASE WHEN quality = 1 THEN 'procedente' ELSE 'improcedente' END AS manual, CASE WHEN n_chars > 1000 THEN 'procedente' ELSE 'improcedente' END AS automatico FROM documents JOIN labels USING (doc_id)), m AS (SELECT manual, automatico, count(*) AS n FROM p GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    label = lambda c: F.when(c, "procedente").otherwise("improcedente")
    return validate.confusion(d.select(label(F.col("quality") == 1).alias("manual"), label(F.col("n_chars") > 1000).alias("automatico")))


@query(f"WITH {_PREDICTED} SELECT * FROM m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"""WITH {_PREDICTED}, l AS (SELECT manual AS rotulo FROM m UNION SELECT automatico FROM m), s AS (SELECT rotulo, (SELECT sum(n) FROM m WHERE manual = rotulo) AS reais, (SELECT sum(n) FROM m WHERE automatico = rotulo) AS prev, (SELECT sum(n) FROM m WHERE manual = rotulo AND automatico = rotulo) AS ok FROM l)
SELECT rotulo, round(coalesce(ok / prev, 0), 6) AS precisao, round(coalesce(ok / reais, 0), 6) AS cobertura, round(coalesce(2 * ok / (prev + reais), 0), 6) AS f1, coalesce(reais, 0)::BIGINT AS suporte FROM s""")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.label_metrics(_matrix(spark, sf_dir)).select("rotulo", *r6("precisao", "cobertura", "f1"), "suporte")


@query("SELECT count(*) AS pares, count_if((quality = 1) = (n_chars > 1000))::BIGINT AS iguais, round(count_if((quality = 1) = (n_chars > 1000)) / count(*), 6) AS taxa FROM documents JOIN labels USING (doc_id)")
def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda c: F.when(c, "procedente").otherwise("improcedente")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("numero"), label(F.col("n_chars") > 1000).alias("resultado"))
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("numero"), label(F.col("quality") == 1).alias("resultado"))
    return validate.agreement(cases, docs).select("pares", "iguais", *r6("taxa"))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, md5(doc_id::VARCHAR) AS o, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) ORDER BY r > 40 // (SELECT count(DISTINCT lang) FROM documents), o, doc_id LIMIT 40""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return validate.stratified(d, "lang", 40, "doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")))


@query("SELECT event_type, (props->>'$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 499) ORDER BY ts, event_id LIMIT 500")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 500 by the cursor that the first page ends with."""
    e, order = table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]
    return paging.page(e, order, 500, paging.cursor(paging.page(e, order, 500), order)).select("event_id", "ts")


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def per_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.first_of_each(table(spark, sf_dir, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey")


@query("""SELECT o_orderkey, lpad(n, 7, '0') || '-' || lpad(dd::VARCHAR, 2, '0') || '.2020.8.26.0100' AS numero, true AS valido, 'tjsp' AS tribunal FROM (SELECT o_orderkey, (o_orderkey % 10000000)::VARCHAR AS n, 98 - ((o_orderkey % 10000000)::HUGEINT * 10000000000000 + 2020826010000) % 97 AS dd FROM orders)""")
def case_number_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 10_000_000
    dd = 98 - ((n % 97) * (10**13 % 97) + 2020826010000 % 97) % 97
    number = F.concat(F.lpad(n.cast("string"), 7, "0"), F.lit("-"), F.lpad(dd.cast("string"), 2, "0"), F.lit(".2020.8.26.0100"))
    first = F.get(courts.case_numbers(F.concat(F.lit("processo "), F.col("numero"), F.lit(" e "), F.col("numero"))), F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("numero")).select("o_orderkey", first.alias("numero"), courts.valid_number(F.col("numero")).alias("valido"), courts.court_of_number(F.col("numero")).alias("tribunal"))


_EVENT_NAMES = {"purchase": "Procedência", "error": "Extinção sem resolução de mérito", "signup": "Não-Provimento", "click": "Homologação de transação"}


@query("SELECT CASE event_type WHEN 'purchase' THEN 'procedente' WHEN 'error' THEN 'extinto_sem_merito' WHEN 'signup' THEN 'nao_provido' WHEN 'click' THEN 'homologacao_acordo' END AS resultado, count(*) AS n FROM events GROUP BY 1")
def movement_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lit(None).cast("string")
    for kind, words in _EVENT_NAMES.items():
        name = F.when(F.col("event_type") == kind, words).otherwise(name)
    e = table(spark, sf_dir, "events").withColumn("resultado", movements.of_movement(F.lit(0), name))
    return e.groupBy("resultado").agg(F.count("*").alias("n"))

"""Published measures over units: shares, rates with intervals, quartiles, cross tables. All plain aggregations.

Every order has a total tie-break. Small groups are suppressed on the denominator that a rate rests on (least).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabelion.functions import stats
from tabelion.functions.courts import branch_of
from tabelion.functions.movements import APPEAL_MERIT, GRANTED, MERIT, REVERSED, UNDETERMINED
from tabelion.functions.stats import LEAST_PUBLISHED, LEAST_AMOUNT, MOST_AMOUNT, quartiles, wilson
from tabelion.functions.text import first_given, telling_tokens

# Words that only repeat the outcome or the pseudonyms.
NOT_VOCABULARY = tuple(
    """
pessoa cpf cnpj rg oab cep telefone email endereco conta procedente procedentes improcedente improcedentes procedência
improcedência parcialmente julgo provimento poder judiciário tribunal justiça estado sentença vistos processo comarca vara foro
""".split()
)


def given(name: str, default: str) -> Column:
    return F.coalesce(first_given(F.col(name).cast("string")), F.lit(default))


#: Name of a grouping -> Column; an array column stands for several groups of one unit.
GROUPINGS = {
    "ramo": lambda: branch_of(F.col("tribunal")),
    "tribunal": lambda: F.upper(given("tribunal", "desconhecido")),
    "grau": lambda: given("grau", "não informado"),
    "ano": lambda: F.coalesce(first_given(F.substring(F.col("data_julgamento").cast("string"), 1, 4)), F.lit("sem data")),
    "classe": lambda: given("classe_nome", "não informada"),
    "assunto": lambda: subjects(F.col("assuntos")),
}


def subjects(column: Column) -> Column:
    """Names of all subjects, repeats included, or one default."""
    names = F.filter(F.transform(F.coalesce(column, F.array().cast("array<struct<codigo:int,nome:string>>")), lambda a: a["nome"]), lambda n: F.coalesce(n != "", F.lit(False)))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("não informado")))


def grouped(units: DataFrame, grouping: str | Column) -> DataFrame:
    """units with a column grupo; a unit of several groups appears in each."""
    key = GROUPINGS[grouping]() if isinstance(grouping, str) else grouping
    several = isinstance(grouping, str) and grouping == "assunto"
    return units.withColumn("grupo", F.explode(key) if several else key)


def distribution(units: DataFrame, outcome: str = "resultado") -> DataFrame:
    counts = units.groupBy(outcome).agg(F.count("*").alias("n"))
    return counts.withColumn("proporcao", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("n"), outcome)


def rates(units: DataFrame, grouping: str | Column, least: int = LEAST_PUBLISHED) -> DataFrame:
    """Full grants, grants, and reversals per group, with Wilson's bounds; null where the denominator is below least."""
    return _published(grouped(units, grouping).groupBy("grupo").agg(*_counts()), least).orderBy(F.desc("total"), "grupo")


#: Groupings of which a unit has one value each.
SINGLE = ("ramo", "tribunal", "grau", "ano", "classe")


def rates_of_all(units: DataFrame, groupings: tuple[str, ...] = SINGLE, least: int = LEAST_PUBLISHED) -> DataFrame:
    """rates() of several groupings at once, by the column agrupamento: units are read and counted in one pass of grouping sets."""
    keyed = units.select("resultado", *(GROUPINGS[g]().alias(f"__{g}") for g in groupings))
    names = [f"__{g}" for g in groupings]
    counts = keyed.groupingSets([[n] for n in names], *names).agg(*_counts(), *(F.grouping(n).alias(f"{n}_out") for n in names))
    which = F.coalesce(*(F.when(F.col(f"__{g}_out") == 0, g) for g in groupings))
    named = counts.withColumns({"agrupamento": which, "grupo": F.coalesce(*names)})
    return _published(named, least, "agrupamento").orderBy("agrupamento", F.desc("total"), "grupo")


def _counts() -> list[Column]:
    is_in = lambda labels: F.count_if(F.col("resultado").isin(*labels))
    return [F.count("*").alias("total"), is_in(MERIT).alias("merito"), is_in(APPEAL_MERIT).alias("recursos"), is_in(("procedente",)).alias("full"), is_in(GRANTED).alias("granted"), is_in(REVERSED).alias("reversed")]


def _published(counts: DataFrame, least: int, *keys: str) -> DataFrame:
    columns = {}
    for name, hits, of in (("procedencia", "full", "merito"), ("acolhimento", "granted", "merito"), ("provimento", "reversed", "recursos")):
        for suffix, value in zip(("", "_ic_inf", "_ic_sup"), wilson(F.col(hits), F.col(of)), strict=True):
            columns[name + suffix] = F.when(F.col(of) >= least, value)
    kept = counts.where((F.col("merito") >= least) | (F.col("recursos") >= least))
    return kept.select(*keys, "grupo", "total", "merito", "recursos", *(c.alias(n) for n, c in columns.items()))


def spread(df: DataFrame, grouping: str | Column, value: str, names: tuple[str, str, str], least: int = LEAST_PUBLISHED, huge: bool = False) -> DataFrame:
    """n, median and quartiles of a value per group; rows without the value don't count. huge: groups whose values no buffer should hold."""
    if huge:
        found = stats.exact_quantiles(grouped(df, grouping), ["grupo"], value, dict(zip(names, (0.5, 0.25, 0.75), strict=True)))
        return found.where(F.col("n") >= least).orderBy(F.desc("n"), "grupo")
    out = grouped(df.where(F.col(value).isNotNull()), grouping).groupBy("grupo").agg(F.count("*").alias("n"), quartiles(F.col(value)).alias("q")).where(F.col("n") >= least)
    return out.select("grupo", "n", *(F.get("q", F.lit(i)).alias(names[k]) for k, i in enumerate((1, 0, 2)))).orderBy(F.desc("n"), "grupo")


def durations(cases: DataFrame, grouping: str | Column, least: int = LEAST_PUBLISHED, huge: bool = False) -> DataFrame:
    return spread(cases, grouping, "duracao_dias", ("mediana_dias", "q1_dias", "q3_dias"), least, huge)


def award_amounts(units: DataFrame, category: str = "danos_morais", grouping: str | Column = "tribunal", least: int = LEAST_PUBLISHED) -> DataFrame:
    """The first amount of a category in granting first-instance units; implausible ones are dropped, not replaced by the next."""
    amount = F.get(F.filter(F.col("calculo.valores"), lambda v: v["categoria"] == category), F.lit(0))["valor"]
    kept = units.where((F.col("instancia") == "1") & F.col("resultado").isin(*GRANTED)).withColumn("amount", amount)
    return spread(kept.where(F.col("amount").between(LEAST_AMOUNT, MOST_AMOUNT)), grouping, "amount", ("mediana", "q1", "q3"), least)


def side(outcome: Column) -> Column:
    return F.when(outcome.isin(*GRANTED, *REVERSED), "acolhido").when(outcome.isin("improcedente", "nao_provido"), "rejeitado")


def shares_by_side(documents: DataFrame, item: str, key: str = "id", outcome: str = "resultado", top: int = 30, least: int = LEAST_PUBLISHED) -> DataFrame:
    """For each item of an array column: documents that have it, and its share among granting and denying ones."""
    sided = documents.withColumn("side", side(F.col(outcome))).where("side is not null")
    totals = sided.agg(F.count_if(F.col("side") == "acolhido").alias("all_a"), F.count_if(F.col("side") == "rejeitado").alias("all_r"))
    counts = sided.select("side", F.explode(F.array_distinct(item)).alias("citacao")).groupBy("citacao").agg(
        F.count("*").alias("documentos"), F.count_if(F.col("side") == "acolhido").alias("a"), F.count_if(F.col("side") == "rejeitado").alias("r")
    )
    rows = counts.where(F.col("documentos") >= least).join(F.broadcast(totals))  # one row of totals
    return rows.select("citacao", "documentos", F.try_divide("a", "all_a").alias("em_acolhidos"), F.try_divide("r", "all_r").alias("em_rejeitados")).orderBy(F.desc("documentos"), "citacao").limit(top)


def vocabulary(documents: DataFrame, text: str, outcome: str = "resultado") -> DataFrame:
    """z of each word between granting and denying documents, from a column of their report and grounds."""
    sided = documents.withColumn("side", side(F.col(outcome))).where("side is not null")
    words = sided.select("side", F.explode(telling_tokens(F.col(text), without=NOT_VOCABULARY)).alias("word"))
    return stats.log_odds(words.groupBy("word").agg(F.count_if(F.col("side") == "acolhido").alias("n_a"), F.count_if(F.col("side") == "rejeitado").alias("n_b")))


def vocabulary_tables(scores: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    names = scores.select(F.col("word").alias("palavra"), "z", F.col("n_a").alias("n_acolhidos"), F.col("n_b").alias("n_rejeitados"))
    return names.where("z > 0").orderBy(F.desc("z"), "palavra").limit(top), names.where("z < 0").orderBy("z", "palavra").limit(top)


def national_rates(units: DataFrame, least: int = LEAST_PUBLISHED) -> DataFrame:
    """Pooled rate with bounds, and the unweighted mean, least and greatest of the courts' rates; three measures in one pass."""
    measures = (("procedência", MERIT, ("procedente",)), ("acolhimento", MERIT, GRANTED), ("provimento", APPEAL_MERIT, REVERSED))
    cells = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("medida"), F.col("resultado").isin(*of).alias("counts"), F.col("resultado").isin(*hit).alias("hit")) for i, (name, of, hit) in enumerate(measures)))
    courts = units.select(given("tribunal", "?").alias("tribunal"), F.inline(cells)).where("counts").groupBy("ord", "medida", "tribunal").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    rate = F.when(F.col("n") >= least, F.col("hits") / F.col("n"))
    pooled = courts.groupBy("ord", "medida").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.count(rate).alias("tribunais"), F.avg(rate).alias("media_tribunais"),
        F.min(rate).alias("minimo_tribunais"), F.max(rate).alias("maximo_tribunais"),
    ).where(F.col("n") >= least)
    p, low, high = wilson(F.col("hits"), F.col("n"))
    return pooled.orderBy("ord").select("medida", "n", p.alias("agregada"), low.alias("agregada_ic_inf"), high.alias("agregada_ic_sup"), "tribunais", "media_tribunais", "minimo_tribunais", "maximo_tribunais")


def reversals_by_appeal(units: DataFrame, least: int = LEAST_PUBLISHED) -> DataFrame:
    """Each strong appeal chapter on the merits counts; one row, or none below least."""
    c = units.select(F.explode("capitulos").alias("c")).where((F.col("c.objeto") == "recurso") & (F.col("c.forca") == "forte") & F.col("c.resultado").isin(*APPEAL_MERIT))
    counts = c.agg(F.count("*").alias("recursos"), F.count_if(F.col("c.resultado").isin(*REVERSED)).alias("hits")).where(F.col("recursos") >= least)
    p, low, high = wilson(F.col("hits"), F.col("recursos"))
    return counts.select("recursos", p.alias("provimento"), low.alias("ic_inf"), high.alias("ic_sup"))


def final_outcome(first: Column, action_after: Column, appeal: Column, reason: Column) -> Column:
    """The action's outcome after the appeal."""
    return (
        F.when(action_after.isin(*MERIT), action_after).when(appeal.isin("nao_provido", "nao_conhecido"), first)
        .when(F.coalesce(reason, F.lit("")).contains("anulação"), "sentença anulada")
        .when(first == "parcialmente_procedente", "indeterminado (ambas as partes podem ter recorrido)")
        .when(appeal == "provido", F.when(first == "procedente", "improcedente").otherwise("procedente"))
        .when(appeal == "parcialmente_provido", "parcialmente_procedente").otherwise(UNDETERMINED)
    )


def appealed(units: DataFrame) -> DataFrame:
    """sentenca, recurso, final of each case with a first instance on the merits and a judged appeal."""
    known = units.where(~F.col("numero").startswith("doc:"))
    first = known.where((F.col("instancia") == "1") & F.col("resultado").isin(*MERIT)).select("numero", F.col("resultado").alias("sentenca"))
    second = known.where((F.col("instancia") == "2") & F.col("resultado").isin(*APPEAL_MERIT, "nao_conhecido")).select("numero", F.col("resultado").alias("recurso"), "resultado_acao", "motivo")
    return first.join(second, "numero").select("numero", "sentenca", "recurso", final_outcome(F.col("sentenca"), F.col("resultado_acao"), F.col("recurso"), F.col("motivo")).alias("final"))


def cross_table(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n")).orderBy(F.desc("n"), a, b)


def reversal_rate(pairs: DataFrame) -> DataFrame:
    judged, won = F.count_if(F.col("recurso").isin(*APPEAL_MERIT)), F.count_if(F.col("recurso").isin(*REVERSED))
    return pairs.agg(F.count("*").alias("pares"), F.try_divide(won, judged).alias("taxa_reforma"))


def shares_within(long: DataFrame, least: int = LEAST_PUBLISHED) -> DataFrame:
    """(parametro, valor) rows -> n and share of the parameter's unsuppressed total."""
    counts = long.groupBy("parametro", "valor").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("parametro"))
    return counts.withColumn("proporcao", share).where(F.col("n") >= least).orderBy("parametro", F.desc("n"), "valor")


def calculation_parameters(units: DataFrame, least: int = LEAST_PUBLISHED) -> DataFrame:
    c = lambda name: F.col(f"calculo.{name}")
    one = lambda label, value: F.transform(F.filter(F.array(value), lambda v: F.coalesce(v != "", F.lit(False))), lambda v: F.struct(F.lit(label).alias("parametro"), v.alias("valor")))
    many = lambda label, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(label).alias("parametro"), v.alias("valor")))
    percent = F.concat(F.regexp_replace(F.round(c("honorarios_percentual"), 4).cast("string"), r"\.0$", ""), F.lit("%"))
    cells = F.concat(
        one("honorários (%)", percent), one("repetição do indébito", c("repeticao")), many("juros: termo inicial", c("juros_termos_iniciais")),
        one("juros: taxa", c("juros_taxa")), many("correção: termo inicial", c("correcao_termos_iniciais")), one("correção: índice", c("correcao_indice")),
    )
    return shares_within(units.where((F.col("instancia") == "1") & F.col("resultado").isin(*GRANTED)).select(F.inline(cells)), least)


def reasons(units: DataFrame, outcome: str = "extinto_sem_merito") -> DataFrame:
    kept = units.where((F.col("resultado") == outcome) & (F.col("fonte_resultado") == "texto")).select(given("motivo", "não identificado").alias("motivo"))
    return distribution(kept, "motivo")


def quality(units: DataFrame) -> DataFrame:
    """One row: units, undetermined, confidence and source histograms, two-source units, divergent ones."""
    counts = units.groupBy(given("confianca", "—").alias("confianca"), "fonte").agg(
        F.count("*").alias("n"), F.count_if(F.col("resultado") == UNDETERMINED).alias("open"), F.count_if((F.col("fonte") == "ambos") & F.col("divergente")).alias("apart")
    )
    histogram = lambda key: F.map_from_entries(F.collect_list(F.struct(key, "n")))
    total = counts.agg(F.sum("n").alias("unidades"), F.sum("open").alias("indeterminadas"), F.sum(F.when(F.col("fonte") == "ambos", F.col("n")).otherwise(0)).alias("com_duas_fontes"), F.sum("apart").alias("divergentes"))
    sure = counts.groupBy("confianca").agg(F.sum("n").alias("n")).agg(histogram("confianca").alias("confianca"))
    source = counts.groupBy("fonte").agg(F.sum("n").alias("n")).agg(histogram("fonte").alias("fontes"))
    return total.join(F.broadcast(sure)).join(F.broadcast(source))  # one row each

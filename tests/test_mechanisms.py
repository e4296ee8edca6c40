"""Quantiles, samples, grouping sets, SQL functions and variants against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabelion.functions import sql, stats, text, variants
from tabelion.operators import measures, pseudonyms, validate


@pytest.mark.parametrize("bins", [2, 16, 1024])
def test_exact_quantiles(spark, bins):
    """Null keys and values, ties, groups of one row, negative zero and large values, clashing columns."""
    r = random.Random(bins)
    rows = [(r.choice(["hot", "hot", "hot", None, "b"]), r.choice([None, 1.5, 1.5, -0.0, 1e18, r.gauss(0, 5), float(r.randint(0, 9))])) for _ in range(3000)] + [("one", 7.25), ("none", None)]
    fractions = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").withColumns({"n": F.lit(0), "rank": F.lit(0), "part": F.lit(0)})
    got = {x["k"]: x for x in stats.exact_quantiles(df, ["k"], "v", fractions, bins).collect()}
    assert set(got) == {"hot", None, "b", "one"}
    for k, x in got.items():
        values = [v for g, v in rows if g == k and v is not None]
        assert x["n"] == len(values) and [x[n] for n in fractions] == pytest.approx([float(np.quantile(values, q)) for q in fractions.values()], rel=1e-12, abs=1e-9)
    whole = stats.exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(float(np.quantile([v for _, v in rows if v is not None], 0.5)))
    assert stats.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []


def test_a_skewed_label_is_sampled_in_parts(spark):
    rows = [(i, "common" if i % 50 else (None if i % 100 else "rare")) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(8).withColumns({"order": F.lit(1), "key": F.lit(2), "place": F.lit(3)})
    found = validate.stratified(df, "label", 90, "id", F.col("id") % 997)
    got = sorted((x["label"] or "", x["id"]) for x in found.collect())
    ordered = {label: sorted((i for i, x in rows if x == label), key=lambda i: (i % 997, i)) for label in ("common", None, "rare")}
    assert got == sorted((label or "", i) for label, ids in ordered.items() for i in ids[:30]) and found.columns == df.columns
    assert len(validate.stratified(df, "label", 4000, "id").collect()) == 4000
    assert validate.stratified(df.limit(0), "label", 5, "id").collect() == []


def test_groupings_at_once_are_the_groupings_one_by_one(spark):
    r = random.Random(5)
    unit = "tribunal string, resultado string, grau string, data_julgamento date, classe_nome string"
    rows = [(r.choice(["tjsp", "tjrj", "trf1", None]), r.choice(["procedente", "improcedente", "provido", "nao_provido", "indeterminado"]), r.choice(["G1", "G2", None, ""]), None, r.choice(["c", "d"])) for _ in range(800)]
    u = spark.createDataFrame(rows, unit)
    every = measures.rates_of_all(u).collect()
    for name in measures.SINGLE:
        one = [tuple(x) for x in measures.rates(u, name).collect()]
        assert one and sorted(tuple(x)[1:] for x in every if x["agrupamento"] == name) == sorted(one)


def test_sql_functions_are_the_library_s(spark):
    sql.register(spark)
    rows = [("Ação  Cível\tnº 12.3",), ("",), (None,), ("ÇÃÕ é ñ",)]
    df = spark.createDataFrame(rows, "t string")
    df.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT sem_acentos(t), normalizado(t), so_digitos(t), primeiro_dado(t, 'x') FROM some_texts").collect()
    want = df.select(text.unaccent(F.col("t")), text.folded(F.col("t")), text.digits(F.col("t")), text.first_given(F.col("t"), F.lit("x"))).collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in want]
    low, high = spark.sql("SELECT wilson_inf(7L, 20L), wilson_sup(7L, 20L)").first()
    _, a, b = spark.range(1).select(*stats.wilson(F.lit(7), F.lit(20))).first()
    assert (low, high) == (pytest.approx(a), pytest.approx(b)) and spark.sql("SELECT wilson_inf(0L, 0L), proporcao(1L, 0L), dias_entre(DATE'2020-02-01', DATE'2020-01-01')").first() == (None, None, None)


def test_variants(spark):
    df = spark.createDataFrame([('{"k":1}',), ('{"k":"2"}',), ('{"k":[3]}',), ("{",), (None,), ("7",)], "j string").select(variants.parsed(F.col("j")).alias("v"))
    assert sorted(x["k"] for x in df.withColumns(variants.typed(F.col("v"), k=("$.k", "int"))).collect() if x["k"] is not None) == [1, 2]
    assert {x["forma"]: x["n"] for x in variants.shapes(df, "v").collect()} == {"OBJECT<k: BIGINT>": 1, "OBJECT<k: STRING>": 1, "OBJECT<k: ARRAY<BIGINT>>": 1, "BIGINT": 1, None: 2}


def test_filters_on_masks_stay_above_the_steps(spark):
    """A filter that went below would spell the ten steps out in each other."""
    df = spark.createDataFrame([("CPF 123.456.789-09, RG 12.345.678-9",), ("nada",)], "t string")
    masked = pseudonyms.mask(df, "t").where("counts['CPF'] > 0 AND masked LIKE '%[CPF]%'")
    assert masked.first()["counts"] == {"CPF": 1, "RG": 1}
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 30


def test_many_terms_in_one_pass(spark):
    """Nested, overlapping and self-overlapping terms, other blanks, accents: as term by term."""
    terms = ("dano", "dano moral", "dano moral coletivo", "danos", "moral", "boa-fé", "fé", "a b a", "de má-fé", "litigância de má-fé", "l.g")
    words = ["dano", "moral", "coletivo", "danos", "boa-fé", "a", "b", "litigância", "de", "má-fé", "FÉ", "l.g", "lxg", "danosa", "x_dano"]
    r = random.Random(2)
    rows = [("".join(r.choice(words) + r.choice([" ", "  ", "\n", "\u00a0", ", ", "-"]) for _ in range(r.randint(0, 30))),) for _ in range(300)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    one = [F.regexp_count(text.unaccent(F.lower(F.col("t"))), F.lit(text.term_pattern(t))) for t in terms]
    found = df.select(text.term_counts(F.col("t"), terms).alias("m"), F.array(*one).alias("n"))
    assert all(x["m"] == ({t: n for t, n in zip(terms, x["n"], strict=True) if n} if x["n"][0] is not None else x["m"]) for x in found.collect())
    assert sum(len(x["m"] or {}) for x in found.collect()) > 500
    plan = df.select(text.term_counts(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan


def test_pages_follow_each_other(spark):
    from tabelion.operators import paging

    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "a long, b long").repartition(4)
    order, seen, after = ["a", "b"], [], None
    while rows := (now := paging.page(df, order, 30, after)).collect():
        seen += [(x["a"], x["b"]) for x in rows]
        after = paging.cursor(now, order)
    assert seen == sorted((i % 7, i) for i in range(100)) and paging.page(df, order, 5, paging.cursor(df.limit(0), order)).count() == 0
    assert [x["b"] for x in paging.first_of_each(df, "a", [F.desc("b")], 2).orderBy("a", "b").limit(4).collect()] == [91, 98, 92, 99]


def test_runs(spark):
    rows = [(sorted(random.Random(i).choices("abcde", k=i % 9)),) for i in range(40)] + [([],)]
    got = spark.createDataFrame(rows, "x array<string>").select("x", text.runs(F.col("x")).alias("r")).collect()
    assert all({e["item"]: e["n"] for e in g["r"]} == {c: g["x"].count(c) for c in set(g["x"])} for g in got)


def test_a_long_document_is_counted_in_one_pass(spark):
    """20,000 words, 5,000 of them distinct: a word times a word would be a hundred million comparisons."""
    import json
    import time

    from tabelion.plans import document

    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(5000)]
    decision = " ".join(random.Random(1).choices(words, k=20_000)) + ". Ante o exposto, julgo procedente o pedido, na forma do art. 14 do CDC e do art. 14 do CDC."
    document.analyse_text(spark, "Julgo procedente o pedido.")
    began = time.time()
    found = json.loads(document.analyse_text(spark, decision))
    assert time.time() - began < 20 and found["citacoes"] == {"art. 14 CDC": 2} and len(found["palavras_frequentes"]) == 20
    assert [x["n"] for x in found["palavras_frequentes"]] == sorted((x["n"] for x in found["palavras_frequentes"]), reverse=True)

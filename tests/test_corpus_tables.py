"""Corpus tables: manifests, concurrent writers, buckets."""

import threading

import pytest
from pyspark.sql import functions as F

from tabelion.sources import corpus as module
from tabelion.sources.corpus import Corpus, Taken


def rows(spark, *r):
    return spark.createDataFrame(r, "id string, n int, __arrived string")


def content(corpus):
    return {r["id"]: r["n"] for r in corpus.read("documentos").collect()}


def test_upserts_write_their_own_rows_only(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    assert corpus.read("documentos") is None
    assert corpus.upsert("documentos", rows(spark, *((str(i), 0, "1") for i in range(50)))) == {"rows": 50}
    for k in range(1, 25):
        assert corpus.upsert("documentos", rows(spark, (str(k), k, "1"), (str(k), -1, "0"), (f"new{k}", k, "1")), {"sum": F.sum("n")}) == {"rows": 2, "sum": 2 * k}
    assert content(corpus) == {str(i): i if i < 25 else 0 for i in range(50)} | {f"new{k}": k for k in range(1, 25)}
    _, state = corpus._state("documentos")
    assert state["base"]["rows"] == 50 + 16 and len(state["deltas"]) == 25 - 17 and spark.read.parquet(state["deltas"][-1]["path"]).count() == 2


@pytest.mark.parametrize("sent", [0, 1000])
def test_reading_leaves_the_base_where_it_lies(spark, tmp_path, monkeypatch, sent):
    """No exchange above the scan of the base, whether the deltas' keys are sent or shuffled."""
    monkeypatch.setattr(module, "SENT_KEYS", sent)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus = Corpus(spark, f"file://{tmp_path}/corpus", compact_after=1, bucket_rows=20)
        corpus.upsert("documentos", rows(spark, *((str(i), 0, "1") for i in range(100))))
        corpus.upsert("documentos", rows(spark, *((str(i), 1, "1") for i in range(60))))
        corpus.upsert("documentos", rows(spark, *((str(i), 2, "1") for i in range(30)), ("x", 2, "1")))
        assert content(corpus) == {str(i): 2 if i < 30 else 1 if i < 60 else 0 for i in range(100)} | {"x": 2}
        plan = corpus.read("documentos")._jdf.queryExecution().executedPlan().toString()
        lines = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
        base = next(i for i, line in enumerate(lines.split("\n")) if "FileScan parquet spark_catalog" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(lines.split("\n")[base])
        for line in reversed(lines.split("\n")[:base]):
            if depth(line) < level:
                above.append(line)
                level = depth(line)
        assert above and not any("Exchange" in line for line in above)
        _, state = corpus._state("documentos")
        assert state["base"]["buckets"] == 8
        assert corpus.read("documentos").where("id = '77'").first()["n"] == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_writers_and_one_number(spark, tmp_path):
    """Of two writers that see the same manifest, one has to look again: neither upsert is lost."""
    first, second = (Corpus(spark, f"file://{tmp_path}/corpus") for _ in range(2))
    first.upsert("documentos", rows(spark, ("a", 0, "1")))
    n, state = second._state("documentos")
    first.upsert("documentos", rows(spark, ("a", 1, "1"), ("b", 1, "1")))
    with pytest.raises(Taken):
        second._commit("documentos", n + 1, state)
    taken, real = [], second._state

    def late(table):
        if not taken:  # the first look is at what was true before the other writer's commit
            taken.append(1)
            return n, state
        return real(table)

    second._state = late
    second.upsert("documentos", rows(spark, ("b", 2, "1"), ("c", 2, "1")))
    assert content(first) == {"a": 1, "b": 2, "c": 2}


def test_many_writers_at_once(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus", compact_after=3)
    failures = []

    def write(k):
        try:
            Corpus(spark, f"file://{tmp_path}/corpus", compact_after=3).upsert("documentos", rows(spark, (f"own{k}", k, "1"), ("shared", k, "1")))
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = content(corpus)
    assert not failures and {k: v for k, v in found.items() if k != "shared"} == {f"own{k}": k for k in range(6)} and found["shared"] in range(6)


def test_a_delta_that_lands_during_compaction_stays(spark, tmp_path):
    corpus, other = (Corpus(spark, f"file://{tmp_path}/corpus") for _ in range(2))
    corpus.upsert("documentos", rows(spark, ("a", 0, "1"), ("b", 0, "1")))
    real = corpus._change

    def slowly(table, change):
        other.upsert("documentos", rows(spark, ("a", 1, "1")))
        corpus._change = real
        return real(table, change)

    corpus._change = slowly
    corpus.compact("documentos")
    _, state = corpus._state("documentos")
    assert state["base"]["rows"] == 2 and len(state["deltas"]) == 1 and content(corpus) == {"a": 1, "b": 0}
    # two compactions of the same deltas: one counts
    n, now = corpus._state("documentos")
    lost = Corpus(spark, f"file://{tmp_path}/corpus")
    lost._state = lambda table, once=[(n, now)]: once.pop() if once else Corpus._state(lost, table)
    corpus.compact("documentos")
    lost.compact("documentos")
    assert content(corpus) == {"a": 1, "b": 0}


def test_new_columns_and_nested_types(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus", compact_after=1)
    nested = rows(spark, ("a", 0, "1")).withColumns({"avaliacao": F.struct(F.lit("x").alias("motivo"), F.array(F.struct(F.lit(1.5).alias("valor"))).alias("v")), "substituicoes": F.create_map(F.lit("CPF"), F.lit(1))})
    corpus.upsert("documentos", nested)
    corpus.upsert("documentos", rows(spark, ("b", 1, "1")).withColumn("novo", F.lit("y")))
    corpus.upsert("documentos", nested.withColumn("n", F.lit(9)))
    found = {r["id"]: r for r in corpus.read("documentos").collect()}
    assert (found["a"]["n"], found["a"]["avaliacao"]["v"][0]["valor"], found["a"]["substituicoes"], found["a"]["novo"]) == (9, 1.5, {"CPF": 1}, None)
    assert found["b"]["novo"] == "y" and found["b"]["avaliacao"] is None

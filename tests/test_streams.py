"""Streams and pushdown of the paged sources over fake transports that count what is asked for."""

import fcntl
import json
import os
import tempfile
import time
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabelion.sources import config, paged
from tabelion.sources.corpus import Corpus
from tabelion.streaming import ingest

LOG = Path(tempfile.gettempdir()) / f"tabelion-asked-{os.getuid()}"
HITS = 23


def _hit(court, n):
    return {"_source": {"numeroProcesso": f"{court}{n}", "classe": {"codigo": n % 3, "nome": "c"}, "grau": "G1" if n % 2 else "G2", "dataAjuizamento": "20190528000000", "nivelSigilo": 0, "assuntos": [], "movimentos": []}, "sort": [n]}


def _told(what):
    with LOG.open("a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(json.dumps(what | {"at": time.time()}) + "\n")


def asked():
    return [json.loads(x) for x in LOG.read_text().splitlines()] if LOG.exists() else []


def transport(method, url, headers, body):
    """An index of HITS cases a court that knows the criteria of the query, and two notices a day."""
    if method == "GET":
        court, day, page = url.split("siglaTribunal=")[1].split("&")[0], url.split("Inicio=")[1][:10], int(url.split("pagina=")[1].split("&")[0])
        _told({"court": court.lower(), "day": day, "page": page})
        items = [{"id": f"{court}{day}{i}", "texto": f"Ante o exposto, julgo procedente o pedido {i}.", "tipoDocumento": "Sentença", "data_disponibilizacao": day} for i in range(2)]
        return json.dumps({"items": items[page - 1 : page]}).encode()
    query, court = json.loads(body), url.split("api_publica_")[1].split("/")[0]
    hits = [_hit(court, n) for n in range(1, HITS + 1)]
    for group in query["query"].get("bool", {}).get("must", []):
        allowed = [next(iter(next(iter(x.values())).items())) for x in group["bool"]["should"]]
        of = {"numeroProcesso": lambda h: h["_source"]["numeroProcesso"], "grau": lambda h: h["_source"]["grau"], "classe.codigo": lambda h: h["_source"]["classe"]["codigo"]}
        hits = [h for h in hits if any(of[f](h) == v for f, v in allowed)]
    hits = [h for h in hits if h["sort"] > query.get("search_after", [0])][: query["size"]]
    bare = query.get("_source") is False
    _told({"court": court, "after": query.get("search_after"), "served": 0 if bare else len(hits), "bare": bare})
    return json.dumps({"hits": {"hits": [{"sort": h["sort"]} if bare else h for h in hits]}}).encode()


NAME = "tests.test_streams:transport"


@pytest.fixture(autouse=True)
def fresh_log():
    LOG.unlink(missing_ok=True)
    yield
    LOG.unlink(missing_ok=True)


def job(**datajud):
    return config.Job("fluxo", tribunais=["tjsp", "tjrj", "tjmg"], datajud=config.CaseQuery(tamanho_pagina=4, **datajud), djen=config.NoticeQuery(data_inicio=date(2025, 1, 1), data_fim=date(2025, 1, 5), itens_por_pagina=1))


def kept_batches(folder, die_in=None):
    """Each batch in a folder of its own, as written by what counts batches once; batch die_in fails after its write."""
    def write(batch, epoch):
        batch.select("tribunal", "numero", "cursor").write.mode("overwrite").json(f"{folder}/{epoch}")
        if epoch == die_in:
            raise RuntimeError("the stream dies here")

    return write


def test_a_killed_stream_gives_each_record_once(spark, tmp_path):
    out, checkpoint = tmp_path / "out", str(tmp_path / "checkpoint")
    stream = lambda: ingest.live(spark, "court_cases", job(), NAME, pages="2")
    query = ingest.follow(stream(), kept_batches(out, die_in=1), checkpoint)
    with pytest.raises(Exception, match="dies here"):
        query.processAllAvailable()
    before = len(asked())
    query = ingest.follow(stream(), kept_batches(out), checkpoint)
    query.processAllAvailable()
    query.stop()
    found = [(r["tribunal"], r["numero"]) for r in spark.read.json([str(p) for p in sorted(out.iterdir()) if p.is_dir()]).collect()]
    assert sorted(found) == sorted((c, f"{c}{n}") for c in ("tjsp", "tjrj", "tjmg") for n in range(1, HITS + 1))
    assert len(list(out.iterdir())) >= 3
    # the batch that died is read again, what came before it is not
    assert {x["after"][0] for x in asked()[before:] if not x["bare"]} == {8, 12, 16, 20}
    # nothing new: a third start asks where the end is, and for no record
    before = len(asked())
    query = ingest.follow(stream(), kept_batches(out), checkpoint)
    query.processAllAvailable()
    query.stop()
    assert all(x["bare"] for x in asked()[before:])


def test_a_stream_keeps_the_limit_and_fills_the_corpus(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    query = ingest.live_cases(spark, job(limite_por_tribunal=10), corpus, str(tmp_path / "c"), NAME, pages="1")
    query.processAllAvailable()
    query.stop()
    assert {r["tribunal"]: r["count"] for r in corpus.cases(True).groupBy("tribunal").count().collect()} == {"tjsp": 10, "tjrj": 10, "tjmg": 10}


def test_notices_stream_by_day(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    for _ in range(2):  # the second start has nothing to do
        query = ingest.live_notices(spark, job(), corpus, str(tmp_path / "c"), NAME, days="2")
        query.processAllAvailable()
        query.stop()
    assert corpus.documents(True).count() == 3 * 5 * 2
    days = [(x["court"], x["day"], x["page"]) for x in asked()]
    assert len(days) == len(set(days)) and {d for _, d, _ in days} == {f"2025-01-0{i}" for i in range(1, 6)}


def read(spark, source, **query):
    paged.register(spark)
    j = job(**query)
    return spark.read.format(source).options(**paged.options(j.datajud if source == "court_cases" else j.djen, ["tjsp", "tjrj", "tjmg"], {}, NAME)).load()


def rows(df):
    return sorted((r["tribunal"], r["numero"]) for r in df.collect())


@pytest.mark.parametrize("condition", ["grau = 'G1'", "classe_codigo IN (1, 2) AND grau = 'G2'", "tribunal = 'tjrj' AND classe_codigo = 0", "numero = 'tjsp5'", "tribunal IN ('tjsp', 'tjmg') AND numero > 'tjsp2'", "grau = 'G1' OR classe_codigo = 0"])
def test_filters_reach_the_index(spark, condition):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    every = read(spark, "court_cases").cache()
    wanted = rows(every.where(condition))
    whole = sum(x["served"] for x in asked())
    every.unpersist()
    LOG.unlink()
    assert rows(read(spark, "court_cases").where(condition)) == wanted
    served = sum(x["served"] for x in asked())
    assert served == whole if " OR " in condition else served < whole


def test_a_limit_counts_the_same_hits(spark):
    """With a limit of raw hits, filters stay in Spark."""
    assert rows(read(spark, "court_cases", limite_por_tribunal=6).where("grau = 'G1'")) == sorted((c, f"{c}{n}") for c in ("tjsp", "tjrj", "tjmg") for n in (1, 3, 5))


def test_filters_thin_out_days(spark):
    found = read(spark, "court_notices").where("dia >= DATE'2025-01-02' AND dia < DATE'2025-01-04' AND tribunal = 'tjmg'").select("dia", F.get_json_object("hit", "$.id").alias("id")).collect()
    assert len(found) == 4 and {x["day"] for x in asked()} == {"2025-01-02", "2025-01-03"} and {x["court"] for x in asked()} == {"tjmg"}


def test_all_lanes_keep_one_interval(spark):
    paged.register(spark)
    options = paged.options(config.CaseQuery(tamanho_pagina=12), ["tjsp", "tjrj", "tjmg", "tjac", "tjal"], {}, NAME) | {"interval": "0.2"}
    began = time.time()
    assert spark.read.format("court_cases").options(**options).load().count() == 5 * HITS
    times = sorted(x["at"] for x in asked())
    assert len(times) == 10 and times[-1] - times[0] > 0.2 * 6 and time.time() - began < 30
    # lanes begin at the same moment; after that no second sees more than the interval allows
    assert all(sum(t <= x < t + 1.6 for x in times) <= 1.6 / 0.2 + paged.LANES for t in times)

"""Neighbours, URL templates, archives, Jaccard join, language model and pipeline against plain versions."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabelion.llm import jaccard_join, katz, permutation_index, url_filter, warc
from tabelion.llm import queries as Q
from tests.llm import brute


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[100]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0]), (905, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "block", "near")})
    found = permutation_index.neighbours(df).collect()
    hits = total = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        best = [int(i) for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:20]
        got = [(r["rank"], r["vec_id"]) for r in found if r["query_id"] == q]
        assert [k for k, _ in sorted(got)] == list(range(1, 21))
        hits, total = hits + len(set(best) & {v for _, v in got}), total + 20
        if 100 <= q < 400:
            assert [v for _, v in sorted(got)][:5] == best[:5]
    assert hits / total >= 0.9 and {r["query_id"] for r in found} == set(range(0, 900, 20))
    assert permutation_index.neighbours(df.limit(0)).count() == 0
    assert permutation_index.neighbours(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_neighbours_of_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = e.toPandas()
    x, ids = np.array(p["embedding"].tolist(), float), p["vec_id"].to_numpy()
    got = permutation_index.neighbours(e).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(g["vec_id"]))
    assert hits / len(got) >= 0.9


@pytest.mark.parametrize("kind", ["few", "clusters", "longer"])
def test_recall_does_not_rest_on_many_rows_nor_on_even_ones(spark, kind):
    """A fifth of the rows is ranked however few there are; clustered vectors and rows that are far longer than most."""
    rng = np.random.default_rng(4)
    x = {"few": rng.normal(size=(300, 32)), "clusters": rng.normal(size=(20, 32))[rng.integers(20, size=1500)] + 0.3 * rng.normal(size=(1500, 32)), "longer": rng.normal(size=(1500, 32))}[kind]
    if kind == "longer":
        x[7, 3] = 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = permutation_index.neighbours(df).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(own["vec_id"]))
        assert kind != "longer" or x[q, 3] <= 0 or own.loc[own["rank"] == 1, "vec_id"].item() == 7
    assert hits / len(found) >= 0.9


def plain_rule(host, path):
    best = None
    for rule in Q.URL_RULES:
        d, _, p = rule.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def test_urls(spark, small):
    urls = [(1, None), (2, "no scheme"), (3, "http://WWW.Ex.com/en/1?x#y"), (4, "https://a.example.com/en/77"), (5, "ftp://example.net"), (6, "x://h#f://z"), (7, "http://org/es/1"), (7, "http://org/es/1")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "segment", "template", "n")})
    got = {r["page_id"]: r for r in url_filter.judge(df, Q.URL_RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(1, 8)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("www.ex.com", "/en/1", "com/en/", "block"), ("a.example.com", "/en/77", "example.com/en/7", "allow"),
        ("example.net", "", None, "allow"), ("h", "", None, "allow"), ("org", "/es/1", "org/es/", "block"),
    ]
    assert url_filter.judge(df, Q.URL_RULES).count() == len(urls) and url_filter.judge(df.limit(0), Q.URL_RULES).count() == 0
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in Q.op5_url_template_tree(spark, small).collect():
        rest = pages[r["page_id"]].split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        rule = plain_rule(host.lower(), path)
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, rule) and (not rule or r["verdict"] == Q.URL_RULES[rule])


def test_templates_are_rejected_by_labels(spark):
    rows = [(i, f"http://h.org/spam/{i}", i < 20 or None) for i in range(40)] + [(100 + i, f"http://h.org/good/{i}", False if i < 20 else None) for i in range(40)] + [(200 + i, f"http://h.org/user{chr(97 + i)}/x", None) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judge(df, {}, bad=F.col("bad")).collect()}
    assert all(got[i]["verdict"] == "block" for i in range(40)) and all(got[100 + i]["verdict"] == "allow" for i in range(40))
    assert {got[200 + i]["template"] for i in range(12)} == {"/{*}/{*}"} or len({got[200 + i]["template"] for i in range(12)}) == 1


def test_archives(spark):
    rows = [(5, "u\r\nx", "same"), (2, None, "same"), (9, "u", None), (1, "u", ""), (7, "u", "é" * 300_000), (7, "u", "é" * 300_000), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("refers_to", "digest", "frame")})
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive(df).collect()), key=repr)
    assert got == sorted([(5, "revisit", 2, 4), (2, "response", None, 4), (9, "revisit", 1, 0), (1, "response", None, 0), (7, "response", None, 600_000), (7, "response", None, 600_000), (None, "response", None, 4)], key=repr)
    assert warc.archive(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive(df, min_bytes=10**9).collect()} == {"response"}


def test_records_are_fetched_by_the_index(spark, small):
    from tabelion.llm.common import Stages

    pages = spark.read.parquet(f"{small}/pages.parquet")
    stages = Stages(spark, "test")
    root = stages.path("bundles")
    index = stages.keep(warc.write(pages, root), "index")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in warc.fetch(index.where("record_id % 50 = 3"), root).collect():
        assert bytes(r["record"]).startswith(b"WARC/1.1\r\n") and html[r["record_id"]].encode() in bytes(r["record"])
    for r in Q.op7_warc_bundles(spark, small).collect():
        body = html[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100_000)
    monkeypatch.setattr(warc, "READ_FRAMES", 1)
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    df = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("html"))
    read = warc.archive(df)
    assert read.rdd.getNumPartitions() > 5 and read.count() == 400


def test_jaccard_join(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 60))
    rows = []
    for i in range(60):  # a large group of near copies, not all of which are linked directly
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(60))] = f"x{rng.integers(1000)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(i, " ".join(rng.choice(words, int(rng.integers(1, 80))))) for i in range(40)]
    common = " ".join(rng.choice(words, 30))
    rows += [(300 + i, f"{common} " + " ".join(rng.choice(words, 4 + i % 5))) for i in range(25)] + [(400, None), (401, ""), (402, "one two"), (403, "ONE  two"), (404, " \t\n"), (500, rows[0][1]), (501, rows[0][1].upper())]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "node", "gram", "component", "met")})
    want = brute.components(rows)
    got = jaccard_join.join(df).collect()
    assert len(got) == len(rows) + 3 and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    one = jaccard_join.one_of_each(df)
    assert one.columns == df.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert jaccard_join.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("first", [0, 500])
def test_jaccard_join_goes_on_without_head_pairs(spark, first):
    """Two near copies whose shared columns are headed by a text that neither of them can be linked with."""
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    shared, licence = run("s", 99), run("l", 104)
    texts = [f"{shared} {run('b', 5)} {licence}", f"{shared} {run('b', 5)}", f"{shared} {run('c', 5)}", *(f"{licence} {run(f'o{k}x', 100)}" for k in range(4))]
    ids = [r["id"] for r in spark.range(first, first + len(texts)).orderBy(F.xxhash64("id", F.lit(0))).collect()]  # the first heads round 0
    rows = list(zip(ids, texts, strict=True))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows) and got[ids[1]][1] == got[ids[2]][1]


def test_jaccard_join_of_different_texts_with_one_id(spark):
    """The set of least digest stands for an id, whatever the order of rows."""
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, run("a", 50)), (1, run("b", 50)), (2, run("a", 50) + " end"), (3, run("b", 50) + " end"), (None, run("a", 50)), (None, None)]
    seen = set()
    for order in (rows, rows[::-1]):
        got = jaccard_join.join(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and sorted(r["n_shingles"] for r in got) == [0, 46, 46, 46, 47, 47]
        seen.add(tuple(sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"])))
    assert len(seen) == 1 and {c for i, c in seen.pop() if i == 1} == {1}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_language_model(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "never seen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("chunk", "part", "held")})
    want, n = brute.katz(rows)
    got = katz.score(df).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (w[0], w[1], w[2], n)
        assert r["base_score"] == pytest.approx(w[3], abs=1e-6) and r["score"] == pytest.approx(w[4], abs=1e-6)


@pytest.mark.parametrize("rows", [[(1, "a a a a b")], [(1, "a"), (2, "a")], [(9, "x y"), (9, "x y"), (1, None)]])
def test_language_model_on_few_texts(spark, rows):
    want, n = brute.katz(rows)
    for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][4], abs=1e-9) and r["train_tokens"] == n


def test_language_model_on_nothing(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline(spark, small):
    """Each stage on what the one before kept: decisions against plain versions."""
    from tabelion.llm import decontaminate, pii, toxicity
    from tabelion.llm.common import table

    docs = table(spark, small, "documents")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, small, "labels"))
    kept = {i: t for i, t in start.items() if model.at_least([t]).sum() < model.threshold}
    kept = {i: kept[i] for i, (_, c) in brute.components(kept.items()).items() if c == i}
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()])
    kept = {i: t for i, t in kept.items() if not items.leaks([t])[0]}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(out) == set(kept) and len(corpus_pipeline.STAGES) == 5
    base = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    for r in pii.redact(base).collect():
        assert out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_the_tree_decides_pages_without_a_rule(spark):
    """On the given urls: siblings pool their labels, so pages that no rule fits are blocked with their template, others are allowed."""
    got = Q.op5_url_template_tree(spark, "/root/testdata/sf0.1").select("host", "rule", "verdict", "template").collect()
    free = [r for r in got if r["rule"] is None]
    blocked = {(r["host"], r["template"]) for r in free if r["verdict"] == "block"}
    assert 0 < sum(r["verdict"] == "block" for r in free) < len(free) / 4
    labels = {}
    for r in got:
        if r["rule"] is not None:
            labels.setdefault((r["host"], r["template"]), []).append(url_filter_action(r["rule"]) == "block")
    assert all(len(labels[t]) >= url_filter.MIN_LABELLED and sum(labels[t]) >= 0.85 * len(labels[t]) for t in blocked)


def url_filter_action(rule):
    return Q.URL_RULES[rule]


def test_rounds_don_t_grow_with_the_path(spark):
    """Two paths of 2,000 segments that part in the last one, and a short one; empty segments, braces."""
    long = "http://x.org/" + "/".join(f"s{i}x" for i in range(1999))
    rows = [(1, long + "/a"), (2, long + "/b"), (3, "http://x.org/a"), (4, "http://x.org//"), (5, "http://y.org/{x}/\\y")]
    got = {r["page_id"]: r["template"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), {}).collect()}
    assert got[1].count("/") == got[2].count("/") == 2000 and got[4] == "/{end}/{end}" and "\\{x}" in got[5] and len(got) == 5


def odd_tables(spark, at, rows, labels, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("id", "words", "hash", "n", "chunk", "label", "ids", "body")})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}"


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns; then no labels and no benchmark; then no documents."""
    long = " ".join(f"wort{i}" for i in range(30_000))
    rows = [(1, "a plain text about nothing at all", "en", "s", 33), (1, "a plain text about nothing at all", "en", "s", 33), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id but a text of its own here", "en", "s", 3), (4, long, "de", "s", 9), (5, long + " end", "de", "s", 9), (6, "write to ann@example.com or 10.0.0.1 today please", "en", "s", 1), (7, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "s", 1)]
    items = [(1, "quick brown fox jumps over the lazy dog near the old river"), (2, None), (None, ""), (3, "x")]
    at = odd_tables(spark, tmp_path / "a", rows, [(1, 1, 0), (None, None, None), (9, None, 1)], items)
    kept = {}
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{at}/documents.parquet").columns, name
    ids = lambda name: sorted(r["doc_id"] or 0 for r in kept[name])
    assert ids("toxicity") == [0, 1, 1, 2, 3, 4, 5, 6, 7] and 7 not in ids("decontamination") and {2, 3, 6} <= set(ids("decontamination"))
    assert not {4, 5} <= set(ids("jaccard_join")) and {4, 5} & set(ids("jaccard_join"))
    assert {r["doc_id"]: r["text"] for r in kept["pii"]}[6] == "write to [EMAIL] or [IP] today please"
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.run(spark, at).collect()) == ids("bpe")
    bare = odd_tables(spark, tmp_path / "b", rows, [], [])
    assert {0, 1, 2, 3, 6, 7} <= {r["doc_id"] or 0 for r in corpus_pipeline.run(spark, bare).collect()}
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "c", [], [], [])).collect() == []

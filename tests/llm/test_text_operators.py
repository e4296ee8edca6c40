"""BPE, toxicity, decontamination, personal data and quotes against plain versions and edge cases."""

import hashlib
import random

import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from tabelion.llm import bpe, decontaminate, pii, quotes, toxicity
from tabelion.llm import queries as Q
from tests.llm import brute

RANKS = P.path("byte_bpe_50k.tiktoken")
ALL = bpe.read_ranks(RANKS)
ODD = [(1, None), (2, ""), (3, "I'm we're  they'll\t x ² ½ é日本語 \U0001f600 don't'sx \n\n  end  "), (4, "a" * 2000), (5, "\t\t x 　y"), (6, "word " * 3000), (6, "word " * 3000)]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def frame(spark, rows):
    """Rows with further columns of names that the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "pieces", "n", "node", "component", "digest", "spans", "words")})


def test_bpe_equals_the_library_and_decodes(spark, encoding):
    df = frame(spark, ODD)
    ids = bpe.encode(df, RANKS, P.PATTERN)
    for r in ids.collect():
        assert list(r["ids"]) == encoding.encode_ordinary(dict(ODD)[r["doc_id"]] or "")
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(ids, RANKS).collect()} == {i: t or "" for i, t in ODD}
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe.decode(spark.createDataFrame([(1, [999999])], "doc_id long, ids array<int>"), RANKS).collect()


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab th'sé \n日1２"), max_size=60))
def test_contraction(encoding_text):
    enc = tiktoken.Encoding("own2", pat_str=r"[\s\S]+", mergeable_ranks=ALL, special_tokens={})
    if encoding_text:
        with bpe.Codec.of(RANKS) as codec:
            made = codec.contracted([encoding_text])[0]
        assert list(made[bpe.IDS]) == enc.encode_ordinary(encoding_text) and made[bpe.DECODED] == encoding_text.encode()


def test_pieces_of_a_batch_are_laid_by_arrow(encoding, monkeypatch):
    """Rows equal the library's, also of a sliced batch and as memories turn over; each distinct piece is asked for once a batch."""
    texts = ["", "the cat sat on the mat " * 300, "é日本 \x00\xff 12!!", "x" * (bpe.LONG + 1), "", "the mat"]
    split = pa.array([[], *([encoding.decode_single_token_bytes(i).decode("latin-1") for i in range(300)],), *(regex.findall(P.PATTERN, t) for t in texts), []], pa.list_(pa.string()))
    monkeypatch.setattr(bpe, "MEMORY", 4)
    with bpe.Codec.of(RANKS) as codec:
        asked, contracted = [], codec.contracted
        monkeypatch.setattr(codec, "contracted", lambda pieces: asked.append(len(pieces)) or contracted(pieces))
        for _ in range(3):
            ids, decoded = codec.rows(split.slice(2, len(texts)))
            want = [encoding.encode_ordinary(t) for t in texts]
            assert ids.to_pylist() == want and [bytes(x) for x in bpe.each(decoded)] == decoded.to_pylist() == [t.encode() for t in texts]
            assert [bytes(x).decode() for x in codec.decimals(ids)] == [" ".join(map(str, x)) for x in want]
        assert asked == [len({p for t in texts for p in regex.findall(P.PATTERN, t)})] * 3
        for empty in ([], [[], []]):
            ids, decoded = codec.rows(pa.array(empty, pa.list_(pa.string())))
            assert ids.to_pylist() == empty and decoded.to_pylist() == [b""] * len(empty) and [bytes(x) for x in codec.decimals(ids)] == [b""] * len(empty)


def test_long_pieces_take_their_time_in_proportion():
    """On both sides of the length from which a queue replaces the recursion; a megabyte without blanks ends."""
    enc = tiktoken.Encoding("own3", pat_str=r"[\s\S]+", mergeable_ranks=ALL, special_tokens={})
    r = random.Random(3)
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3 * bpe.LONG) for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éü漢字", "0123456789=+/")]
    texts.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)))
    with bpe.Codec.of(RANKS) as codec:
        made = codec.contracted(list(dict.fromkeys(texts)))
    for text, piece in zip(dict.fromkeys(texts), made, strict=True):
        assert piece[bpe.DECODED] == text.encode()
        assert list(piece[bpe.IDS]) == enc._core_bpe.encode_single_piece(text.encode())
    assert not codec.young and not codec.old


def test_bpe_query(spark, small, encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in Q.op2_byte_bpe(spark, small).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bad = ["scum", "moron", "trash", "loser", "clown"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(60)] + (rng.sample(bad, 3) if toxic else []))))
        labels.append((i, 1, int(toxic)))
    docs, first = frame(spark, rows + [(900, None), (901, "")]), spark.createDataFrame(labels[:400] + [(900, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, first)).collect()}
    assert sum(found[i]["toxic"] == bool(t) for i, _, t in labels[400:]) >= 195
    assert not found[900]["toxic"] and not found[901]["toxic"] and all(0 <= r["severity"] <= 2 for r in found.values())
    model = toxicity.fit(docs, first)
    assert model.cuts[0] < model.cuts[1] and toxicity.reject(docs, model).columns == docs.columns
    flat = toxicity.fit(docs, first.limit(0))
    assert toxicity.reject(docs, flat).count() == 602


def test_toxicity_on_the_given_labels(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    r = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").groupBy("truth", "toxic").count().collect()
    n = {(x["truth"], x["toxic"]): x["count"] for x in r}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.88 and n.get((0, True), 0) / n[0, False] < 0.01


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(8)] + [(8, None), (9, ""), (10, "a b")]
    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "zzz" + str(rng.random())
        return " ".join(w)

    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{noise(30)} {t.upper().replace(' ', ', ')}. {noise(9)}") for i, t in items[:4]] + [(10 + i, f"{noise(5)} {edited(t, 3)} {noise(50)}") for i, t in items[:8]] + [(30 + i, noise(80)) for i in range(20)] + [(60, None), (61, "")]
    rows += [(70 + i, f"{noise(5)} {edited(t, 12)} {noise(5)}") for i, t in items[:8]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(frame(spark, rows), bench).collect()}
    expected = set()
    for d, t in rows:
        w = [x.decode() for x in decontaminate.words(t)]
        for i, it in items[:8]:
            x = [y.decode() for y in decontaminate.words(it)]
            if any(brute.edits(x, w[s : s + m]) <= 4 for s in range(max(1, len(w))) for m in range(16, 25)):
                expected.add((d, i))
    assert set(found) <= expected and len(found) >= 0.95 * len(expected) and all(found[i, i] == 0 for i in range(4))
    clean = decontaminate.reject(frame(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert decontaminate.find(frame(spark, rows), bench.limit(0)).count() == 0


def test_recall_of_each_length():
    """Items with as many edits as the tolerance allows, in texts of their own: fresh trials, 10 to 300 words."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**6)}"
    lengths = [n for n in (10, 20, 30, 45, 60, 100, 150, 300) for _ in range(3)]
    texts = [[word() for _ in range(n)] for n in lengths]
    items = decontaminate.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
    leaking = []
    for k, n in list(enumerate(lengths)) * 30:
        x = list(texts[k])
        for _ in range(n // 5):
            at, kind = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (kind != 1)] = [] if kind == 2 else ["new" + word()]
        leaking.append((k, " ".join([*(word() for _ in range(20)), *x, *(word() for _ in range(20))])))
    found = [(lengths[k], k in f) for (k, _), f in zip(leaking, items.leaks([t for _, t in leaking]), strict=True)]
    share = {n: sum(f for m, f in found if m == n) / 90 for n in lengths}
    assert all(s >= (1 if n >= 100 else 0.95) for n, s in share.items()), share


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.@-+ (1)2 34é5٣%0"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_personal_data(spark):
    model = pii.fit()
    rows = list(pii.make(600, 99))
    import numpy as np

    p = model.probability(np.array([pii.features(t, s) for t, s, _ in rows], float)) >= model.threshold
    y = np.array([ok for *_, ok in rows])
    assert y[p].mean() > 0.95 and p[y].mean() > 0.9
    df = frame(spark, [(1, "mail a.b@mail.example.org or call (979) 555-6697 now"), (2, None), (3, ""), (4, "card 4111 1111 1111 1111, ip 10.0.0.300 and 10.0.0.3"), (5, "v 2.0.1 of 2024-05-12")])
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL] or call [PHONE] now", 2: None, 3: "", 4: "card [CARD], ip 10.0.0.300 and [IP]", 5: "v 2.0.1 of 2024-05-12"}
    spans = {r["doc_id"]: r for r in pii.spans(df).collect()}
    assert [s["kind"] for s in spans[1]["base"]] == ["email"] and len(spans[1]["spans"]) == 2 and spans[2]["spans"] == []


def test_every_written_address_counts():
    """Recall over all spans that are written, proposed or not; cases and separators that stand alone; sentences stay."""
    model = pii.fit()
    rows = [r for r in pii.written(4000, 98) if r[4] == "email"]
    hits = [any(k == 0 and min(b, end) - max(a, begin) >= 0.8 * (end - begin) for a, k, b in found) for (_, begin, end, _, _), (_, found) in zip(rows, pii.find([r[0] for r in rows], model), strict=True)]
    assert len(rows) > 300 and sum(hits) / len(hits) > 0.95
    for s in ("jane.doe at example.com", "jane at example[dot]com", "JANE [AT] EXAMPLE [DOT] COM", "bob (AT) site.org", "bob at site.com"):
        text = f"please write {s}. Thanks a lot"
        assert [text[a:b] for a, k, b in pii.find([text], model)[0][1] if k == 0] == [s]
    for text in ("We arrived at noon. The sun was high.", "Look at example.com for more", "they were at it. Then they left"):
        assert pii.find([text], model)[0][1] == []


def test_personal_data_query(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in Q.op10_boosted_pii(spark, small).collect():
        base = brute.personal(texts[r["doc_id"]])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[1] == i for s in base) for i in range(len(pii.BASE_KINDS))]


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> Hello there.\n> How are you?\nFine."), (1, 2, "user", "Bob wrote:\n> > Hello there.\n> > How are you?\n> Fine.\nGreat"), (1, 3, "user", ">  how ARE you?\nagain"), (1, 4, "user", None), (2, 0, "user", ""), (2, 0, "user", ""), (2, None, "user", ">x"), (None, 1, "a", "b"), (3, 0, "u", "a"), (3, 1, "u", "b"), (3, 2, "u", "> a\nc")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(0) for c in ("body", "hash", "conv", "position")})
    got = {(r["conv_id"], r["turn"], r["body"]): (r["parent_turn"], r["root_turn"], r["depth"], r["position"]) for r in quotes.link(df).collect()}
    assert got[1, 1, "Fine."] == (0, 0, 1, 1) and got[1, 2, "Great"] == (1, 0, 2, 2) and got[1, 3, "again"] == (0, 0, 1, 3) and got[1, 4, ""] == (None, 4, 0, 4)
    assert [got[3, t, b][3] for t, b in ((0, "a"), (2, "c"), (1, "b"))] == [0, 1, 2] and quotes.link(df).count() == len(rows)
    assert quotes.link(df.limit(0)).count() == 0


def quoting(seed, n):
    """Conversations whose messages quote earlier ones: whole, some paragraphs with new line breaks, lines, sentences, nested, or nothing that was said."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(3, 9))).capitalize() + r.choice(".!?")
    paragraph = lambda: r.choice((" ", "\n")).join(sentence() for _ in range(r.randint(1, 3)))
    rows = []
    for conv in (None, -1, *range(n)):
        bodies = []
        for turn in range(r.randint(1, 9)):
            body, top = "\n\n".join(paragraph() for _ in range(r.randint(1, 3))), ""
            for _ in range(r.choice((0, 1, 1, 2)) if bodies else 0):
                source, mark = r.choice(bodies), r.choice(("> ", ">", "> > ", ">>"))
                cut = r.choice((source, source.upper(), r.choice(source.split("\n\n")).replace("\n", "  "), r.choice(source.split("\n")), r.choice(source.split(". ")), sentence()))
                top += r.choice(("", "Ann wrote:\n")) + "\n".join(mark + line for line in cut.split("\n")) + "\n"
            rows.append((conv, turn, "user", top + body))
            bodies.append(body)
    return rows


@pytest.mark.parametrize("bucket", [2, 1024])
def test_planted_quotes_are_linked(spark, monkeypatch, bucket):
    """All links, depths and positions of 60 conversations against all-pairs comparison; short stretches too. Null and -1 are two conversations."""
    monkeypatch.setattr(quotes, "BUCKET", bucket)
    rows = quoting(5, 60)
    want = brute.threads([(c, t, role, *quotes.split(text)) for c, t, role, text in rows])
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["root_turn"], r["depth"], r["position"], r["n_linked"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == want and sum(p is not None for p, *_ in got.values()) > 100


def test_labelled_rows_of_other_words_all_count(spark):
    texts = [f"shared words and own{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[0].upper()])], "doc_id long, text string")
    labels = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = toxicity.sample(docs, labels, "doc_id", "text", "id", 1000, toxicity.Stages(spark, "test")).collect()
    assert len(rows) == 40


def test_long_texts_of_personal_data_end(spark):
    """A megabyte of each pattern's characters: time in proportion to the length."""
    import time

    model = pii.fit()
    for text in ("1" * 10**6, "1." * 500_000, "1 " * 500_000, "+(" * 500_000, "a at " * 200_000, "ab1" * 300_000, "1:" * 500_000):
        begin = time.perf_counter()
        pii.find([text], model)
        assert time.perf_counter() - begin < 30, text[:6]
    assert pii.base_spans("x " + "7" * 10**6 + ".1.2.3 y 10.0.0.1") == [(10**6 + 11, 1, 10**6 + 19)]


@pytest.mark.parametrize("kinds", decontaminate.EDITS)
def test_each_kind_of_edit_is_found(kinds):
    """Items of 12 to 60 words after all the edits of a kind that are allowed."""
    import numpy as np

    rng = np.random.default_rng(5)
    items = decontaminate.Items([(i, " ".join(f"w{rng.integers(5000)}" for _ in range(n))) for i, n in enumerate([12, 20, 30, 45, 60] * 4)])
    names = {v: k.decode() for k, v in items.places.items()}
    trials = [(k, items.edited(k, rng, kinds)) for k in range(len(items.items)) for _ in range(10)]
    found = items.leaks([" ".join(names.get(w) or f"zz{rng.integers(10**9)}" for w in x.tolist()) for _, x in trials])
    assert sum(k in f for (k, _), f in zip(trials, found, strict=True)) >= 0.97 * len(trials)


def test_bare_digits_are_no_secrets(spark, small):
    """Runs of digits, identifiers, versions and words stay; keys and tokens go. In the given documents nothing but tokens is added."""
    model = pii.fit()
    for text in ("anshon 9870157079875996 athe", "token 98701570798759961234", "see isbn 9780306406157 and 20240512T101112Z", "commit 40d78a45c418324758e099eb7cb89bc0f5fa9f62", "the path some_words_in_a_row2 or img_holiday_20240512.jpg"):
        assert [s for s in pii.find([text], model)[0][1] if pii.KINDS[s[1]] == "secret"] == [], text
    for text in ('token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"', "api_key=sk-Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4z0AbCdEf", "password: ghp_16C7e42F292c6912E7710c838347Ae178B4a"):
        assert [pii.KINDS[s[1]] for s in pii.find([f"x {text} y"], model)[0][1]] == ["secret"], text
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    added = [t[a - 9 : a].lower() for t, (base, every) in zip(texts, pii.find(texts, model), strict=True) for a, k, b in every if (a, k, b) not in base]
    assert added and set(added) == {'token = "'}


def test_ordinal_regression_against_its_likelihood():
    """At what ordinal() returns, the penalised likelihood, written out row by row, has no slope by finite differences, and no step aside is better."""
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    x = (rng.random((240, 4)) < 0.4).astype(np.float32)
    z = x @ np.array([2.0, 1.0, 0.5, -1.0]) + rng.logistic(size=240)
    grade = (z > 1).astype(int) + (z > 2.5)
    weights, cuts = toxicity.ordinal(x, grade)

    def loss(w, c):
        sig = lambda a: 1 / (1 + math.exp(-a))
        total = 0.0
        for row, g in zip(x, grade, strict=True):
            s = [sig(c[0] - float(row @ w)), sig(c[1] - float(row @ w))]
            total -= math.log([s[0], s[1] - s[0], 1 - s[1]][g])
        return total / len(x) + 1e-5 * float(w @ w)

    best, h = loss(weights, cuts), 1e-4
    assert cuts[0] < cuts[1] and (weights >= 0).all() and weights[3] == 0  # the word that speaks against toxicity is held at 0
    for i in range(4):
        up, down = weights.copy(), weights.copy()
        up[i] += h
        down[i] -= h
        slope = (loss(up, cuts) - loss(down, cuts)) / (2 * h)
        assert abs(slope) < 2e-3 if weights[i] > 0 else slope > 0
    for i in range(2):
        up, down = cuts.copy(), cuts.copy()
        up[i] += h
        down[i] -= h
        assert abs(loss(weights, up) - loss(weights, down)) / (2 * h) < 2e-3
    assert all(loss(np.maximum(weights + rng.normal(0, s, 4), 0), np.sort(cuts + rng.normal(0, s, 2))) > best - 1e-5 for s in (0.01, 0.1, 0.5) for _ in range(40))


def test_severity_is_the_expected_grade(spark, small):
    """The query's severities, grades and verdicts, from the fitted weights and cuts by hand."""
    import math
    import re

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in Q.op6_ordinal_toxicity(spark, small).collect():
        low = texts[r["doc_id"]].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        z = sum(model.weights[i] for w, i in model.places.items() if w.decode() in set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)))
        at_most = [1 / (1 + math.exp(-(c - z))) for c in model.cuts]
        each = [at_most[0], at_most[1] - at_most[0], 1 - at_most[1]]
        severity = each[1] + 2 * each[2]
        assert r["severity"] == pytest.approx(severity, abs=1e-6) and r["toxic"] == (r["severity"] >= model.threshold) and each[r["grade"]] >= max(each) - 1e-9

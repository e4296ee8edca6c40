"""Work that grows no faster than the tables: rules tried where they may match, tasks by rows, results read once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabelion.functions import text
from tabelion.operators import amounts, decisions, pseudonyms, rules
from tabelion.plans import examples, readings

TEXTS = [row[0] for rows in (examples.RULINGS, examples.DISMISSALS, examples.DECISIONS, examples.CHAPTERS, examples.AMOUNTS, examples.CALCULATIONS) for row in rows]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_tried_where_a_stem_is(monkeypatch):
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, plain):
            tried.append(self.pattern.pattern)
            return self.pattern.finditer(plain)

    monkeypatch.setattr(rules, "COMPILED", tuple(map(Counted, rules.COMPILED)))
    decisions.claims("intime-se o autor para juntar documentos")
    assert not tried
    decisions.claims("concedo a seguranca")
    assert len(tried) == 3


def test_every_match_holds_a_stem():
    plain = [decisions.folded(t) for t in TEXTS]
    matched = [(m[0], rule.stems.split()) for rule in rules.RULES for t in plain for m in re.finditer(rule.pattern, t)]
    assert len({str(s) for _, s in matched}) > 20 and all(any(s in m for s in stems) for m, stems in matched)
    odd = ["ANTE O EXPOSTO, julgo.", "Ante o expoſto, julgo.", "x\nDİSPOSITIVO\njulgo", "x\ndıspositivo\njulgo"]  # what ignoring case also takes
    assert all(decisions.parts("Razões. " + t).ruling == ("Razões. " + t)[re.search(rules.CONCLUSION, "Razões. " + t).start() :].strip() for t in odd)
    for name, pattern in amounts.CATEGORIES.items():
        assert all(amounts._CATEGORIES[name].near(m[0]) for t in plain for m in re.finditer(pattern, t)), name
    for p in (amounts._LEGAL_AID, amounts._PER_CLAIMANT, amounts._DOUBLED, amounts._SIMPLE, amounts._INTEREST_START, amounts._CORRECTION_START, *amounts._RATES.values(), *amounts._INDICES.values()):
        assert all(p.near(t) for t in plain if p.pattern.search(t))


def test_tasks_grow_with_rows(spark, monkeypatch, tmp_path):
    """A table of more splits than cores, most of them without rows, as large row groups make them."""
    monkeypatch.setattr(readings, "ROWS_A_TASK", 100)
    spark.range(2000).withColumnRenamed("id", "k").repartition(16).write.parquet(str(tmp_path / "t"))
    tasks = readings.spread(spark.read.parquet(str(tmp_path / "t")), "k").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == 20 and max(x["count"] for x in tasks) < 200


@pytest.mark.parametrize("name", ["chapters_counted", "decisions_reclassified", "amounts_named"])
def test_texts_are_read_once_and_after_they_are_dealt(spark, small, name):
    shown = plan(getattr(readings, name)(spark, small))
    assert len(re.findall(r"run\(", shown)) == 1 and shown.index("run(") < shown.index("RepartitionByExpression")


def test_a_text_is_folded_once_for_all_terms(spark):
    df = spark.createDataFrame([("Dano moral e boa-fé.",)], "t string")
    shown = plan(df.select(text.term_counts(F.col("t")).alias("m")))
    assert shown.count("regexp_extract_all(") == 1 and shown.count("translate(") == 1


def test_markup_is_read_once(spark, small):
    """Once for the text, not again for each test of it, and after the notices are dealt to tasks."""
    shown = plan(readings.notices_converted(spark, small))
    assert shown.count("<[^>]+>") == 1 and shown.index("<[^>]+>") < shown.index("RepartitionByExpression")


def test_names_are_replaced_without_a_pattern_for_each_text(monkeypatch):
    """Names within names, other blanks and cases, parts of words: as one pattern of all names would."""
    names = ["ana maria souza", "maria souza", "joão", "maria"]
    t = "Ana  Maria\tSouza, MARIA SOUZA e Maria; Joãozinho, JOÃO_1, joão."
    every = "|".join(r"\s+".join(n.split(" ")) for n in names)
    tags = {n: f"[PESSOA_{i}]" for i, n in enumerate(names, 1)}
    want = re.subn(rf"(?<!\w)(?:{every})(?!\w)", lambda m: tags[" ".join(m[0].lower().split())], t, flags=re.I)
    monkeypatch.setattr(pseudonyms, "names", lambda text, known: names)
    monkeypatch.setattr(pseudonyms.re, "subn", lambda *a, **k: pytest.fail("a pattern was made"))
    assert pseudonyms.without_names(t, []) == want and want[1] == 4


def test_masks_look_for_what_a_pattern_needs(spark):
    rows = ["ana@x.br", "12345678/0001-95", "CPF 12345678909", "cpf 123.456.789-09", "r.g. 1234567", "rg: 12.345.678-9", "oab/sp 1234", "SP123456", "cep 01310100", "01310-100", "3333-4444", "AGÊNCIA 1234", "conta corrente 12345", "c/c 123-4", "Al. Santos, 12", "Praça Azul 3", "123", ""]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    found = pseudonyms.mask(df, "t").select("masked", pseudonyms.masked(F.col("t")).alias("want")).collect()
    assert all(x["masked"] == x["want"] for x in found) and sum(x["masked"].startswith("[") for x in found) >= 12


def test_accented_words_with_signs_are_read_by_units(monkeypatch):
    import public_tokenizers

    from tabelion.llm.token_files import Encoder

    encoder, words = Encoder(public_tokenizers.path("word_bpe_49k.json")), ["été,", "(mañana)", "größe-12;", "ação.", "l’été"]
    want = [encoder.ids(w) for w in words]
    encoder._learn(set(words))
    assert [encoder.young[w] for w in words] == want and {"été", "mañana", "größe", "ação"} <= set(encoder.young)


def test_words_of_a_batch_are_looked_up_once_and_their_units_encoded_at_once(monkeypatch):
    import public_tokenizers

    from tabelion.llm import token_files

    class Counted(dict):
        looked_up = 0

        def __getitem__(self, word):
            Counted.looked_up += 1
            return super().__getitem__(word)

    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["uma Casa, été?! größe-12; ǀǀ l’été don't \u65e5\u672c a</w>b x<|endoftext|>y  \n" * 500, "", "w" * 100 + " casa", "e\u0301 Casa"]
    tail = np.array([7], encoder.width).tobytes()
    want = [encoder.ids(t) + tail for t in texts]
    encoder.young = Counted()
    assert encoder.encode(texts, tail).to_pylist() == want and Counted.looked_up < 100
    monkeypatch.setattr(token_files, "MEMORY", 3)
    for _ in range(3):  # generations change
        assert encoder.encode(texts, tail).to_pylist() == want
    assert encoder.encode([]).to_pylist() == []

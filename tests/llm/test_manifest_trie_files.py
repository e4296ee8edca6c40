"""Operators 11 to 13 against plain versions: Merkle manifest, prefix trie, token-id files."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabelion.llm import merkle, ordered, token_files, tries
from tabelion.llm import queries as Q
from tabelion.llm.common import Stages
from tabelion.session import shared_dir
from tests.llm import brute

as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
DOCS, CONVERSATIONS = ("doc_id", "source", "lang", "n_chars", "text"), ("conv_id", "turn", "role", "text")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TAMPERED = "crc32(CAST(doc_id AS STRING)) % 5 = 0"


def test_manifest_of_the_given_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*DOCS).collect()]
    got = Q.op11_merkle_manifest(spark, small).collect()
    assert as_text(got) == as_text(brute.merkle(rows)) and 0 < sum(not r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_of_hot_null_and_equal_rows(spark, levels):
    """A hot source, null fields and identifiers, repeated rows, a source of one row, one that fills a bucket exactly, clashing columns."""
    r = random.Random(3)
    rows = [(r.choice([None, *range(300)]), "hot" if r.random() < 0.5 else r.choice([None, "", "a", "é", "zz", "Z", "b"]), r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "Ab", "xY z"])) for _ in range(700)]
    rows += [(5000, "solo", "en", 1, "T"), *((i, "full", "en", 1, "T") for i in range(16)), (1, "a", "en", 9, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumns({c: F.lit(1) for c in ("at", "node", "bucket", "more", "id", "after", "left", "every", "name")})
    assert as_text(merkle.manifest(df, F.expr(TAMPERED), levels=levels).collect()) == as_text(brute.merkle(rows))
    assert merkle.manifest(df.limit(0), F.expr(TAMPERED)).collect() == []


def test_trie_of_the_given_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select(*CONVERSATIONS).collect()]
    assert as_text(Q.op12_prefix_trie(spark, small).select(*NODE).collect()) == as_text(brute.trie(rows))


@pytest.mark.parametrize("limit", [12, 100_000])
def test_trie_of_long_copied_and_null_turns(spark, limit):
    """A long thread, snapshots of one thread, copies, null and negative identifiers, null turns, repeated turns; subtries cut by turn and by depth."""
    r = random.Random(3)
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["u", None, "a"]), r.choice(["hi", None, "", "a b", "a b c"])) for c in [None, -25, -5, *range(70)] for t in range(r.randint(0, 6))]
    rows += [(1000, t, "u", "x y") for t in range(100)] + [(1001 + i, t, "u", "x y") for i in range(30) for t in range(3 + i)] + [(900, 0, "u", "q")] * 3 + [(901, 0, "u", "q"), (1500, 0, "u", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("at", "a", "b", "n", "key_a", "digest", "conv", "words", "depth", "top")})
    assert as_text(tries.trie(df, limit=limit, partition=50).select(*NODE).collect()) == as_text(brute.trie(rows))
    assert tries.trie(df.limit(0)).collect() == []


def encode(rows):
    """(doc_id, start, tokens, crc) by the library alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_given_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert as_text(Q.op13_token_files(spark, small).collect()) == as_text(encode(rows))


def test_token_files_of_odd_texts(spark, monkeypatch):
    """Letters, marks, blanks and special strings of all kinds, a long word, a long text; many files and stretches."""
    import public_tokenizers

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    signs = "abcXYZ éÉİßşñǺÅ'sdt \n\t\r\x1c\x85   09٣½Ⅷ,.!日本語한국😀<|endoftext|>ͅΣΑς"
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randint(0, 60)))) for i in range(2000)]
    rows += [(-5, None), (None, "hey <|endoftext|> you<|startoftext|>s"), (7000, "a" * 100_000 + " " + "word " * 100_000), (7001, "I'll don't we'VE 's 'S")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n", "every", "tie", "id", "ends", "counts")}).repartition(5)
    index, root = token_files.files(df, path)
    found = token_files.read(index, root, with_ids=True).collect()
    assert as_text(x[:4] for x in found) == as_text(encode(rows))
    assert all(zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] for x in found)
    assert token_files.round_trip(df.limit(0), path).collect() == []
    assert sorted(x["n_tokens"] for x in token_files.round_trip(spark.createDataFrame([(1, "x")] * 50 + [(2, None)] * 3, "doc_id long, text string"), path).collect()) == [1] * 3 + [2] * 50


def test_variable_length_coding():
    for n in (0, 1, 3, 4, 5, 1000, 70_000):
        x = np.random.default_rng(n).integers(0, [1, 200, 70_000, 2**24, 2**32][n % 5], n).astype(np.uint32)
        control, data = token_files.pack(x)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == x).all()
    for v in (0, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1):
        control, data = token_files.pack(np.array([v], np.uint32))
        assert len(data) == max(1, -(-v.bit_length() // 8)) and token_files.unpack(control, data, 1)[0] == v


def test_running_sums_over_tasks(spark):
    """Keys that stretch over tasks, sums that wrap."""
    rows = [("k" if i % 3 else None, i, 2**62 + i) for i in range(500)] + [("z", 1, -1)]
    got = ordered.numbered(Stages(spark, "test"), spark.createDataFrame(rows, "k string, o long, s long").repartition(3), "k", ["o"], ["s"]).collect()
    want, sums, count = {}, {}, {}
    for k, o, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[k, o] = (count.get(k, 0), (sums.get(k, 0) + s) % 2**64, sums.get(k, 0))
        sums[k], count[k] = want[k, o][1], want[k, o][0] + 1
    assert {(r["k"], r["o"]): (r["at"], r["s"] % 2**64, r["before_s"] % 2**64) for r in got} == want


def test_shared_folder_has_a_scheme(spark):
    assert shared_dir(spark).startswith("file:/")


def test_a_session_without_defaults(tmp_path):
    """Without spark.checkpoint.dir, local mode takes a folder of its own and queries run."""
    code = "from pyspark.sql import SparkSession\nfrom tabelion.llm import queries as Q\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\nassert s.conf.get('spark.checkpoint.dir', None) is None\nassert Q.op7_warc_bundles(s, '/root/testdata/sf0.001').count() > 0\n"
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

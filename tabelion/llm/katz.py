"""Language-model scores by a Katz backoff bigram model with Good-Turing discounts.

Words of a text (A-Z lower-cased) and one end token are scored from left to right, each after the token before it (a
start mark first). P(w | h) = d c(h w) / c(h) if the pair was met in training, else alpha(h) P(w); P(w) = d c(w) / N if
the word was met, else what the discounts left over, for one unseen word. Discounts d of counts up to CUT are
Good-Turing's in Katz's form; where the counts of counts don't yield discounts in (0, 1], absolute discounting by
n1 / (n1 + 2 n2) takes their place. alpha(h) is (1 - sum d c(h w) / c(h)) / (1 - sum P(w)) over the w met after h, so
that P( . | h) sums to 1 over the known words and the unseen one, exactly; where nothing was discounted, one is added to c(h)
or N.

The counts are tables partitioned by hash, held as packed arrays so that they stay small:

1. chunks: each task turns its texts into numbers of its own word list and writes them;
2. word table: word counts meet by word hash; each word gets a global number, its count goes back to the chunks;
3. pair table: each chunk's pairs meet by their history, next to c(w) of their words; the counts each chunk asked for, c(h)
   and what alpha(h) needs go back to it;
4. scoring: each chunk evaluates the recursion per token.

A task holds one chunk (CHUNK_TOKENS) or one partition of a table, whose number grows with the corpus; nothing but the
counts of counts (CUT + 2 sums) goes to the driver. A word that is as frequent as can be is one row of each chunk.

Null texts are empty: one token, the end. Repeated rows count and are scored each. Without training texts every
token is the unseen word, with probability 1.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import ASCII_LOWER, Stages, arrow_limits

CHUNK_TOKENS, CUT = 2_000_000, 5
#: Sums of P(w) travel in units of 2**-42, which is finer than what their rounding adds to a score.
UNIT = 2.0**-42
#: Tokens of the corpus for each partition of a table.
PARTITION_TOKENS = 1_500_000
END, START = b"\x20e", b"\x20s"  # no word holds a space


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_rising(x: np.ndarray) -> bytes:
    """Rising integers as differences, byte plane by byte plane."""
    return pack_planes(np.diff(x, prepend=x.dtype.type(0)))


def unpack_rising(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack_planes(data, kind), dtype=kind)


def pack_planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane."""
    return pack(x.view(np.uint8).reshape(-1, x.itemsize).T)


def unpack_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


CHUNK = "kind string, chunk string, start int, docs binary, held binary, lengths binary, tokens binary, hashes binary, counts binary"


def chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of kind texts for each chunk, with its texts as numbers of the chunk's words, which are ordered by hash, and one of
    kind words, with their hashes and counts in the chunk's training texts."""
    def write(docs: list, held: list, lengths: list, flat: list, place: dict) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in place), np.uint64, len(place))
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        tokens, n = number[np.concatenate(flat)], np.array(lengths, np.int32)
        train = np.repeat(~np.array(held, bool), n)
        counts = np.bincount(tokens[train], minlength=len(order)).astype(np.int64)
        name = uuid.uuid4().hex  # equal chunks are apart; the table is written before any step reads it
        texts = ["texts", name, int(number[0]), pack(np.array(docs, np.int64)), pack(np.array(held, bool)), pack(n), pack_planes(tokens), None, None]
        words = ["words", name, None, None, None, None, None, pack_rising(hashes[order]), pack(counts)]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(texts, words, strict=True), types, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, lengths, flat, size = [], [], [], [], 0
        place: dict[bytes, int] = {START: 0, END: 1}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode().translate(ASCII_LOWER).split()
                flat.append(np.fromiter((place.setdefault(w, len(place)) for w in (*words, END)), np.int32, len(words) + 1))
                docs.append(doc), lengths.append(len(words) + 1), held.append(zlib.crc32(str(doc).encode()) % 7 == 2)
                size += len(words) + 1
                if size >= CHUNK_TOKENS:
                    yield write(docs, held, lengths, flat, place)
                    docs, held, lengths, flat, size, place = [], [], [], [], 0, {START: 0, END: 1}
        if docs:
            yield write(docs, held, lengths, flat, place)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, CHUNK)


def parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of a rising list of hashes begins: parts are ranges of hashes."""
    edges = (np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int64)


def rows_of(names: list[str], rows: list[tuple], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def word_requests(table: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, hashes, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hashes, counts = unpack_rising(hashes, np.uint64), unpack(counts, np.int64)
                at = parts_of(hashes, parts)
                yield rows_of(["part", "chunk", "hashes", "counts"], [(p, chunk, pack_rising(hashes[at[p] : at[p + 1]]), pack(counts[at[p] : at[p + 1]])) for p in range(parts)], [pa.int32(), pa.string(), pa.binary(), pa.binary()])

    return table.select("chunk", "hashes", "counts").mapInArrow(run, "part int, chunk string, hashes binary, counts binary")


def word_table(requests: DataFrame) -> DataFrame:
    """For each chunk's words of a part: total counts and places in the part. A row with chunk '' holds the part's own sums."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_rising(x, np.uint64) for x in pdf["hashes"]]
        every, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(x, np.int64) for x in pdf["counts"]]), len(every)).astype(np.int64)
        met, low = total[total > 0], np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
        # a word's number: parts of the table one after the other, known words in the order of their hashes
        rows = [(pdf["part"][0], "", b"", b"", int(met.sum()), int(len(met)), [int(x) for x in low[1 : CUT + 2]])]
        begin = 0
        for chunk, own in zip(pdf["chunk"], asked, strict=True):
            at = place[begin : begin + len(own)]
            begin += len(own)
            rows.append((pdf["part"][0], chunk, pack_planes(total[at]), pack_rising(at.astype(np.int32)), 0, 0, []))
        return pd.DataFrame(rows, columns=["part", "chunk", "counts", "places", "tokens", "types", "low"])

    return requests.groupBy("part").applyInPandas(add, "part int, chunk string, counts binary, places binary, tokens long, types long, low array<long>")


def discounts(low: list[int]) -> np.ndarray:
    """d for counts 0 .. CUT + 1 (1 from there on); low: how many events were met once, twice, ... CUT + 1 times."""
    n = np.array([0, *low], float)
    d = np.ones(CUT + 2)
    if n[1] > 0:
        tail = (CUT + 1) * n[CUT + 1] / n[1]
        r = np.arange(1, CUT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            turing = ((r + 1) * n[2:] / (r * n[1:-1]) - tail) / (1 - tail)
        if np.isfinite(turing).all() and (turing > 0).all() and (turing <= 1).all():
            d[1:-1] = turing
        else:
            d[1:-1] = (r - n[1] / (n[1] + 2 * n[2] if n[1] + 2 * n[2] > n[1] else 2 * n[1])) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, len(d) - 1)]


def unigram(counts: np.ndarray, of: float, d: np.ndarray, unseen: float) -> np.ndarray:
    """P(w) from counts out of `of` tokens."""
    return np.where(counts > 0, discounted(counts, d) / max(of, 1), unseen)


def pair_requests(table: DataFrame, parts: int) -> DataFrame:
    """Each chunk's distinct pairs, by the history's part: history and word numbers, training counts, c(w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                totals, places, known = chunk_words(row, parts)
                code, count, _ = chunk_pairs(row, len(totals))
                h, w = code // len(totals), code % len(totals)
                at = np.concatenate([[0], np.searchsorted(h, known[1:-1]), [len(h)]])
                for p in range(parts):
                    own = slice(at[p], at[p + 1])
                    # global numbers rise with the chunk's own, as both follow the hashes
                    yield rows_of(["part", "chunk", "h", "w", "counts", "totals"], [(p, row["chunk"], pack_rising(places[h[own]]), pack_planes(places[w[own]]), pack(count[own].astype(np.int32)), pack_planes(totals[w[own]]))], [pa.int32(), pa.string(), *[pa.binary()] * 4])

    return table.mapInArrow(run, "part int, chunk string, h binary, w binary, counts binary, totals binary")


def chunk_words(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words: total counts, global numbers (part, then place), and where each part begins."""
    found = sorted(row["words"], key=lambda x: x["part"])
    counts = [unpack_planes(x["counts"], np.int64) for x in found]
    places = [unpack_rising(x["places"], np.int32).astype(np.int64) | x["part"] << 32 for x in found]
    return np.concatenate(counts), np.concatenate(places), np.concatenate([[0], np.cumsum([len(c) for c in counts])])


def chunk_pairs(row: dict, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (history * n_words + word, rising), their training counts, and which pair each token is."""
    tokens, lengths = unpack_planes(row["tokens"], np.int32).astype(np.int64), unpack(row["lengths"], np.int32)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = row["start"]
    code, which = np.unique(before * n_words + tokens, return_inverse=True)
    train = np.repeat(~unpack(row["held"], bool), lengths)
    return code, np.bincount(which[train], minlength=len(code)), which


def merged(pdf: pd.DataFrame) -> tuple:
    """The part's distinct pairs: histories, total counts, c(w), and which of them each request is."""
    h = np.concatenate([unpack_rising(x, np.int64) for x in pdf["h"]])
    w = np.concatenate([unpack_planes(x, np.int64) for x in pdf["w"]])
    counts = np.concatenate([unpack(x, np.int32) for x in pdf["counts"]])
    totals = np.concatenate([unpack_planes(x, np.int64) for x in pdf["totals"]])
    order = np.lexsort((w, h))
    hs, ws = h[order], w[order]
    new = np.ones(len(order), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
    group = np.cumsum(new) - 1
    which = np.empty(len(order), np.int64)
    which[order] = group
    total = np.bincount(which, counts, int(new.sum()) if len(new) else 0).astype(np.int64)
    return hs[new], total, totals[order][new], which


def pair_table(requests: DataFrame, d1: np.ndarray, of: float, unseen: float) -> DataFrame:
    """For each chunk's pairs of a part: total counts; for its histories c(h), how many words were met once, twice, ... CUT times after h, and
    the sum of P(w) over the words met. A row with chunk '' holds the part's counts of counts."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        hs, total, word_total, which = merged(pdf)
        every, at = np.unique(hs, return_inverse=True)
        c_h = np.bincount(at, total, len(every)).astype(np.int64)
        met = total > 0
        rare = np.stack([np.bincount(at[total == r], minlength=len(every)) for r in range(1, CUT + 1)], 1).astype(np.int32)
        lower = np.bincount(at[met], unigram(word_total[met], of, d1, unseen), len(every))
        low = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
        rows, begin = [(pdf["part"][0], "", b"", b"", b"", b"", [int(x) for x in low[1 : CUT + 2]])], 0
        for chunk, packed in zip(pdf["chunk"], pdf["h"], strict=True):
            own_h = unpack_rising(packed, np.int64)
            own = which[begin : begin + len(own_h)]
            begin += len(own_h)
            first = at[own[np.flatnonzero(np.diff(own_h, prepend=-1))]]
            rows.append((pdf["part"][0], chunk, pack_planes(total[own].astype(np.int32)), pack_planes(c_h[first]), pack_planes(rare[first].ravel()), pack_planes(np.rint(lower[first] / UNIT).astype(np.int64)), []))
        return pd.DataFrame(rows, columns=["part", "chunk", "counts", "c_h", "rare", "lower", "low"])

    return requests.groupBy("part").applyInPandas(add, "part int, chunk string, counts binary, c_h binary, rare binary, lower binary, low array<long>")


def backoff(c_h: np.ndarray, rare: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count that P(w | h) is out of, and alpha(h), for each history."""
    cut_off = (rare * np.arange(1, CUT + 1) * (1 - d[1:-1])).sum(1)
    of = c_h + ((cut_off < 1e-9) & (c_h > 0))  # nothing discounted after h: one count more makes room for the rest
    left = cut_off + (of - c_h)
    return of.astype(float), np.where(c_h > 0, left / np.maximum(of, 1) / np.maximum(1 - lower, 1e-300), 1.0)


def scored(table: DataFrame, parts: int, d1: np.ndarray, d2: np.ndarray, tokens: int, types: int, of: float, unseen: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                totals, _, _ = chunk_words(row, parts)
                code, _, which = chunk_pairs(row, len(totals))
                found = sorted(row["pairs"], key=lambda x: x["part"])
                count = np.concatenate([unpack_planes(x["counts"], np.int32) for x in found]).astype(np.int64)
                history = np.cumsum(np.diff(code // len(totals), prepend=-1) != 0) - 1
                rare = np.concatenate([unpack_planes(x["rare"], np.int32) for x in found]).reshape(-1, CUT)
                c_h, alpha = backoff(np.concatenate([unpack_planes(x["c_h"], np.int64) for x in found]), rare, UNIT * np.concatenate([unpack_planes(x["lower"], np.int64) for x in found]), d2)
                c_h, alpha = c_h[history], alpha[history]
                lower = unigram(totals[code % len(totals)], of, d1, unseen)
                p = np.where(count > 0, discounted(count, d2) / np.maximum(c_h, 1), alpha * lower)
                lengths = unpack(row["lengths"], np.int32)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                words = totals[unpack_planes(row["tokens"], np.int32)]
                sums = lambda x, doc=doc, n=len(lengths): np.bincount(doc, x, n)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpack(row["docs"], np.int64)), pa.array(unpack(row["held"], bool)), pa.array(lengths.astype(np.int64)), pa.array(sums(words > 0).astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(sums(np.log10((words + 1) / (tokens + types + 1)))), pa.array(sums(np.log10(p)[which]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return table.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def low_counts(table: DataFrame) -> list[int]:
    """Summed counts of counts of a table's own rows."""
    sums = table.where("chunk = ''").agg(*(F.sum(F.get("low", F.lit(i))).alias(f"n{i}") for i in range(CUT + 1))).first()
    return [sums[f"n{i}"] or 0 for i in range(CUT + 1)]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = df.sparkSession
    arrow_limits(spark)
    stages = Stages(spark, "katz")
    # bucketed by chunk, so that answers travel to the chunks and the chunks stay where they are
    buckets = max(1, df.select(text_col).rdd.getNumPartitions())
    table, folder = stages.keep_bucketed(chunks(df, id_col, text_col), "chunks", buckets, "chunk", "kind")
    texts = table.where("kind = 'texts'").drop("kind", "hashes", "counts")
    arrow_limits(spark, 1)  # a row is a whole chunk from here on
    try:
        parts = max(1, math.ceil(texts.count() * CHUNK_TOKENS / PARTITION_TOKENS))
        words = stages.keep(word_table(word_requests(table.where("kind = 'words'"), parts)), "words")
        stages.delete(f"{folder}/kind=words")
        sums = words.where("chunk = ''").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
        tokens, types, low = sums["n"] or 0, sums["v"] or 0, low_counts(words)
        d1 = discounts(low)
        cut_off = sum((1 - d1[r]) * r * low[r - 1] for r in range(1, CUT + 1))
        of = tokens if cut_off > 0 else tokens + 1  # as after a history: room for the unseen word
        unseen = (cut_off if cut_off > 0 else 1) / max(of, 1)
        back = words.where("chunk <> ''").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "places")).alias("words"))
        known = texts.join(back, "chunk")
        pairs = stages.keep(pair_table(pair_requests(known, parts), d1, of, unseen), "pairs")
        d2 = discounts(low_counts(pairs))
        answers = pairs.where("chunk <> ''").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "c_h", "rare", "lower")).alias("pairs"))
        found = stages.keep(scored(known.join(answers, "chunk"), parts, d1, d2, tokens, types, of, unseen), "scores")
        stages.drop(words, pairs)
        return found
    finally:
        stages.forget()
        arrow_limits(spark)

"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are encoded, each followed by an end id, and laid out in ascending order of their identifiers (null first; the same
identifier by its text's hash). Ids are replaced by their rank among all ids by frequency (ties: smaller id first), so that the commonest
take one byte. Four ranks share a control byte, two bits each for a length of 1 to 4 bytes; control bytes and data bytes lie apart, and
readers find lengths by a table of all 256 control bytes.

A file, all numbers little-endian:

    magic, ids before the file's first (u64)
    blocks of BLOCK ids: control bytes, then data bytes, of the ids of consecutive documents
    for each document: identifier (i64), 1 if it is null (u8), number of ids (u64)
    for each block: number of ids, data bytes (u32 each)
    number of documents, number of blocks (u64 each), magic

`ranks.bin` beside the files has the ids in the order of their ranks (u32). A document is reached by the file's end and the blocks that hold it.

Stages: texts are dealt by ranges of identifiers, encoded once and kept with the number of ids before them (ordered.numbered), counts of ids (one row for each task and id, at most) give the
ranks, which are sent to all tasks (the vocabulary bounds them), files are written, and read back by groups of blocks. Files have a name of
their own for each task attempt, and only those named by the written index are read, so lost executors leave nothing that counts.

Null texts are empty: one id, the end. Repeated rows are documents each. An empty table yields no files and no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import ASCII_LOWER, Stages, arrow_limits
from tabelion.llm.ordered import numbered

MAGIC, BLOCK, FILE_IDS, END = b"TIDSVB01", 1 << 16, 64 << 20, 2
#: Ids that one reading task decodes; words of a worker's memory in each of two generations, and the longest of these; units that the model gets at once.
READ_IDS, MEMORY, LONGEST, UNITS = 8 << 20, 250_000, 64, 4096

# -- coding ------------------------------------------------------------------------------------------------------------

#: Of each control byte: the four lengths.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
#: Of each length: which bits of four bytes count.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: Of each length less one: a true byte for each of four that is kept.
KEPT = np.array([0x1, 0x101, 0x10101, 0x1010101], "<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    x = ranks.astype("<u4")
    size = np.zeros(-(-len(x) // 4) * 4, np.uint8)  # length less one
    for most in MASKS[1:4]:
        size[: len(x)] += x > most
    four = size.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), x.view(np.uint8)[KEPT[size[: len(x)]].view(bool)].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """n ranks: each four bytes from where it begins, cut off by its length."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    begins = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    return np.ndarray(len(data), "<u4", raw, strides=(1,))[begins] & MASKS[lengths]


# -- tokens ------------------------------------------------------------------------------------------------------------


def small(text: str) -> str:
    """A text with ASCII's capitals as small letters, as the normaliser would write it; others, which marks or special strings might change, as they are."""
    if "<|" in text or not unicodedata.is_normalized("NFC", text):
        return text
    lower = text.encode().translate(ASCII_LOWER).decode()
    return lower if unicodedata.is_normalized("NFC", lower) else text


class Encoder:
    """The library's tokenizer and a memory of the words that it has encoded.

    This vocabulary's tokens never reach over white space, which is dropped, so a text's ids are those of its stretches between spaces
    and line breaks, one after the other.
    """

    _of: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One in each worker, with a bounded memory."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        suffix = told["model"].get("end_of_word_suffix") or ""
        self.by_words = bool(suffix) and [x["type"] for x in told["pre_tokenizer"]["pretokenizers"]] == ["Split", "ByteLevel"] and not any(x["lstrip"] or x["rstrip"] for x in told["added_tokens"])
        #: Ids that end a word.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.width, self.code = ("<u4", "I") if len(self.last) > 1 << 16 else ("<u2", "H")
        # two generations: words that are met again go over to the young one, the others are forgotten with the old one
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: The model alone, for units between blanks.
        self.units = Tokenizer(self.tokenizer.model)
        self.units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Latin small letters as the byte mapping writes them.
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.latin = {c: mapped(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)}
        letters = "a-z" + "".join(map(chr, self.latin))
        #: Words of these, ASCII's letters, digits and signs but apostrophes, are read by units: runs of letters, single digits, runs of other signs.
        self.plain = f"^[{letters}!-&(-~]*$"
        self.split = re.compile(rf"[{letters}]+|[0-9]|\n|[^{letters}0-9\n]+").findall

    def packed(self, ids: list[int]) -> bytes:
        """Little-endian numbers of self.width (as all machines that Spark runs on count)."""
        return array(self.code, ids).tobytes()

    def ids(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _each(self, raw: bytes, n: int) -> list[bytes] | None:
        """The ids of n words that were encoded one after the other, each told by its last token; None if there are not as many of these."""
        ends = (np.flatnonzero(self.last[np.frombuffer(raw, self.width)]) + 1) * np.dtype(self.width).itemsize
        return list(map(raw.__getitem__, map(slice, [0, *ends.tolist()], ends.tolist()))) if len(ends) == n else None

    def _learn_units(self, units: set[str]) -> None:
        """Ids of units in the young memory, the new ones by the model, many at once."""
        young, old, fresh = self.young, self.old, []
        for u in units.difference(young):
            if (x := old.get(u)) is not None:
                young[u] = x
            else:
                fresh.append(u)
        encode = lambda texts: [self.packed(e.ids) for e in self.units.encode_batch_fast(texts, add_special_tokens=False)]
        for i in range(0, len(fresh), UNITS):  # what the library returns takes far more memory than the ids
            some = fresh[i : i + UNITS]
            written = [u if u.isascii() else u.translate(self.latin) for u in some]
            young.update(zip(some, self._each(encode([" ".join(written)])[0], len(some)) or encode(written), strict=True))

    def _learn(self, words: set[str]) -> None:
        """Ids of new words. Words of Latin letters, digits and signs are read by their units, each unit once. Words of other letters are encoded
        together: each is at least one unit, so if there are as many last tokens as words, each is one. All others, those with apostrophes, marks or
        special strings, go through the whole tokenizer one by one."""
        young, old, fresh = self.young, self.old, []
        for w in words:
            if (x := old.get(w)) is not None:
                young[w] = x
            else:
                fresh.append(w)
        told = pa.array(fresh, pa.string())
        plain = pc.and_not(pc.match_substring_regex(told, self.plain, ignore_case=False), pc.match_substring(told, "<|")).to_numpy(zero_copy_only=False)
        whole, letters, rest = [], [], []
        for w, is_plain in zip(fresh, plain.tolist(), strict=True):
            (whole if is_plain else letters if w.isalpha() and not w.isascii() else rest).append(w)
        if whole:
            units = self.split("\n".join(whole).encode().translate(ASCII_LOWER).decode())
            self._learn_units(set(units) - {"\n"})
            parts = []
            at = iter(whole)
            ids = young.__getitem__
            for u in units:
                if u == "\n":
                    young[next(at)] = parts[0] if len(parts) == 1 else b"".join(parts)
                    parts = []
                else:
                    parts.append(ids(u))
            young[next(at)] = b"".join(parts)
        if letters:
            found = self._each(self.ids(" ".join(letters)), len(letters))
            young.update(zip(letters, found, strict=True)) if found else rest.extend(letters)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            young[w] = self.packed(e.ids)

    def encode(self, texts: list[str], tail: bytes = b"") -> pa.Array:
        """Ids of each text and the tail, as little-endian numbers of self.width in a binary array.

        The words of all texts are told apart by Arrow, each distinct one is looked up once, and their ids are laid in the texts' order.
        """
        if not self.by_words:
            return pa.array([self.packed(e.ids) + tail for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], pa.binary())
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        split = pc.split_pattern(pa.array([small(t).replace("\n", " ") for t in texts], pa.string()), " ")
        coded, ends = split.values.dictionary_encode(), split.offsets.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        fresh = set(words).difference(self.young)
        long = {w for w in fresh if len(w) > LONGEST}
        self._learn(fresh - long)
        self.young.update((w, self.ids(w)) for w in long)
        known = pa.array([*map(self.young.__getitem__, words), tail], pa.binary())
        for w in long:
            del self.young[w]
        laid = known.take(pa.array(np.insert(coded.indices.to_numpy(), ends[1:], len(words))))
        bounds = np.frombuffer(laid.buffers()[1], np.int32)[laid.offset : laid.offset + len(laid) + 1]
        bounds = bounds[ends + np.arange(len(ends), dtype=np.int32)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(bounds)), laid.buffers()[2]])


_ENCODED = "every int, id long, ids binary, n long, ends long, counts binary"


def encoded(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (every, id, tie, text), in their order: ids in place of text and their number twice, and at each task's end the counts of all ids."""
    names, types = [c.split()[0] for c in _ENCODED.split(", ")], [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        counts = np.zeros(max(len(encoder.last), end + 1), np.int64)
        tail = np.array([end], encoder.width).tobytes()
        for b in batches:
            ids = encoder.encode(b.column(3).to_numpy(zero_copy_only=False).tolist(), tail)
            n = pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), len(tail))
            # the values of a binary array lie one after the other
            first, last = (np.frombuffer(ids.buffers()[1], np.int32)[i] for i in (0, b.num_rows))
            counts += np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[first:last].view(encoder.width), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, n, n, pa.nulls(b.num_rows, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((0, None, None, 0, 0, counts.tobytes()), types, strict=True)], names=names)

    return run


def id_counts(counts: DataFrame) -> DataFrame:
    """(id, n) over all tasks."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                x = np.frombuffer(raw, np.int64)
                met = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(x[met])], names=["id", "n"])

    return counts.mapInArrow(spread, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- files -------------------------------------------------------------------------------------------------------------


class Writer:
    """A file that is being written: ids come in, blocks go out."""

    def __init__(self, files: fs.FileSystem, path: str, start: int):
        self.path, self.start, self.at, self.out = path, start, start, files.open_output_stream(path, compression=None)
        self.out.write(MAGIC + np.uint64(start).tobytes())
        self.waiting, self.n_waiting = [], 0
        self.docs: list[tuple[int, int, int]] = []
        self.blocks: list[tuple[int, int]] = []

    def add(self, doc: int | None, ranks: np.ndarray) -> None:
        self.docs.append((doc or 0, int(doc is None), len(ranks)))
        self.at += len(ranks)
        self.waiting.append(ranks)
        self.n_waiting += len(ranks)
        if self.n_waiting >= BLOCK:
            every = np.concatenate(self.waiting)
            full = len(every) - len(every) % BLOCK
            for i in range(0, full, BLOCK):
                self._block(every[i : i + BLOCK])
            self.waiting, self.n_waiting = [every[full:]], len(every) - full

    def _block(self, ranks: np.ndarray) -> None:
        control, data = pack(ranks)
        self.out.write(control)
        self.out.write(data)
        self.blocks.append((len(ranks), len(data)))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        self.out.write(np.array(self.docs, np.dtype("<i8,u1,<u8")).tobytes() + np.array(self.blocks, "<u4").tobytes() + np.array([len(self.docs), len(self.blocks)], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """A file's documents and blocks, by its end."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        n_docs, n_blocks = np.frombuffer(file.read_at(16, size - 24), "<u8").tolist()
        if file.read_at(8, size - 8) != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a file of token ids")
        self.start = int(np.frombuffer(file.read_at(8, 8), "<u8")[0])
        table = size - 24 - 8 * n_blocks
        self.docs = np.frombuffer(file.read_at(17 * n_docs, table - 17 * n_docs), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]))
        blocks = np.frombuffer(file.read_at(8 * n_blocks, table), "<u4").reshape(-1, 2).astype(np.int64)
        self.n, self.data = blocks[:, 0], blocks[:, 1]
        self.control = -(-self.n // 4)
        self.at = 16 + np.concatenate([[0], np.cumsum(self.control + self.data)])

    def block(self, k: int) -> np.ndarray:
        raw = self.file.read_at(int(self.control[k] + self.data[k]), int(self.at[k]))
        return unpack(raw[: self.control[k]], raw[self.control[k] :], int(self.n[k]))

    def documents(self, first: int, end: int) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """(identifier, ids before it, number of ids, ranks in pieces) of documents first to end, one block in memory at a time."""
        ends = np.cumsum(self.docs["n"].astype(np.int64))
        now, ranks = -1, None
        for d in range(first, end):
            at, till = int(ends[d] - self.docs["n"][d]), int(ends[d])

            def pieces(at: int = at, till: int = till) -> Iterator[np.ndarray]:
                nonlocal now, ranks
                while at < till:
                    if at // BLOCK != now:
                        now, ranks = at // BLOCK, self.block(at // BLOCK)
                    stop = min(till, (now + 1) * BLOCK)
                    yield ranks[at - now * BLOCK : stop - now * BLOCK]
                    at = stop

            yield None if self.docs["null"][d] else int(self.docs["id"][d]), self.start + at, till - at, pieces()


INDEX = "file string, first int, docs int, start long, ids long"


def write(table: DataFrame, root: str, by_rank: np.ndarray) -> DataFrame:
    """Files of a table (id, ids, n, ends: ids up to and with the document's), written when the index is: a row for each stretch of documents that a task may read."""
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        writer, rows = None, []
        first, since = 0, 0  # of the stretch that is being written: its first document and the ids before it

        def mark() -> None:
            nonlocal first, since
            rows.append((writer.path, first, len(writer.docs) - first, since, writer.at - since))
            first, since = len(writer.docs), writer.at

        for b in batches:
            for doc, raw, n, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer and (writer.at != ends - n or writer.at - writer.start >= FILE_IDS):
                    if len(writer.docs) > first:
                        mark()
                    writer.close()
                    writer = None
                if writer is None:
                    writer, first, since = Writer(files, f"{base}/{uuid.uuid4().hex}.ids", ends - n), 0, ends - n
                writer.add(doc, rank[np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2")])
                if writer.at - since >= READ_IDS:
                    mark()
        if writer:
            if len(writer.docs) > first:
                mark()
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in INDEX.split(", ")])

    return table.select("id", "ids", "n", "ends").mapInArrow(run, INDEX)


def read(index: DataFrame, root: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document in the files that the index names, and its ids if wanted."""
    names = [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        by_rank = None
        for b in batches:
            for path, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if by_rank is None:
                    with files.open_input_file(f"{base}/ranks.bin") as file:
                        by_rank = np.frombuffer(file.read(), "<u4")
                with files.open_input_file(path) as file:
                    rows = []
                    for doc, start, size, pieces in Reader(file).documents(first, first + n):
                        crc, ids = 0, []
                        for ranks in pieces:
                            x = by_rank[ranks]
                            crc = zlib.crc32(x.tobytes(), crc)
                            if with_ids:
                                ids += x.tolist()
                        rows.append((doc, start, size, crc, ids)[: len(names)])
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    parts = index.agg(F.count("*").alias("n"), F.sum("ids").alias("ids")).first()
    tasks = max(1, min(parts["n"], math.ceil((parts["ids"] or 0) / READ_IDS)))  # a stated number, as the index is too small to be split by its own size
    return index.select("file", "first", "docs").repartition(tasks, "file", "first").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> tuple[DataFrame, str]:
    """Writes df's texts, and returns the index of the files and their folder. path: a tokenizer of the tokenizers library."""
    spark = df.sparkSession
    arrow_limits(spark, 1024)  # the more texts at once, the more words are the same
    stages = Stages(spark, "token-files")
    rows = df.select(F.lit(0).alias("every"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = numbered(stages, rows, "every", ["id", "tie"], ["ends"], label="encoded", via=(encoded(path, end), _ENCODED))
    ranked = id_counts(kept.where("counts IS NOT NULL").select("counts")).orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    by_rank = np.array([r["id"] for r in ranked], "<u4")
    root = stages.path("files")
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/ranks.bin", compression=None) as out:
        out.write(by_rank.tobytes())
    index = stages.keep(write(kept.where("counts IS NULL"), root, by_rank), "index")
    stages.drop(kept)
    return index, root


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes the files and reads every document back."""
    return read(*files(df, path, id_col, text_col, end), id_col)

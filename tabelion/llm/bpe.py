"""Byte-level BPE by DuckDB recursive queries in each partition.

Spark's regular expressions split texts into pieces. Each Python worker keeps one DuckDB database with
the merge table. Pieces that the worker hasn't seen go into it as token-position rows; a recursive query
joins neighbours with the merge table and contracts the leftmost pair of least rank of each piece, until
no piece has a pair left. Ordered aggregation over the rows gives ids and decoded text.

The recursion makes a row for each token of each round, the square of a piece's length. Pieces of more than LONG bytes
(a run of letters without blanks, a line of signs) are contracted in the same order from a queue of pairs, in n log n.

Nulls are read as empty texts (no ids, empty text). A worker remembers contracted pieces in two
bounded memories: when the young one is full, it becomes the old one, so what keeps occurring stays. DuckDB spills nothing. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import arrow_limits

#: Unicode's White_Space, which Java's \s doesn't cover.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Pieces and bytes of pieces that each of a worker's two memories holds; bytes of a long piece; pieces of one recursive query, and rows it makes at most.
MEMORY, REMEMBERED, LONG, BLOCK, BLOCK_ROWS = 150_000, 8 << 20, 512, 20_000, 4_000_000

_CONTRACT = """
WITH RECURSIVE st(it, w, p, np, id, nid, rk) AS (
  SELECT 0, s.w, s.p, s.p + 1, s.id, s.nid, m.rank FROM start s LEFT JOIN merges m ON m.pair = s.id::BIGINT * 4294967296 + s.nid
  UNION ALL
  SELECT u.it, u.w, u.p, u.np, u.id, u.nid, m.rank FROM (
    WITH best AS (SELECT w, min(rk::BIGINT << 32 | p) AS k, arg_min(np, rk::BIGINT << 32 | p) AS np FROM st WHERE rk IS NOT NULL GROUP BY w),
    pair AS (SELECT b.w, b.k & 4294967295 AS p, (b.k >> 32)::INTEGER AS merged, b.np, x.np AS after, x.nid AS next_id FROM best b JOIN st x ON x.p = b.np)
    SELECT s.it + 1 AS it, s.w, s.p, CASE WHEN s.p = b.p THEN b.after ELSE s.np END AS np, CASE WHEN s.p = b.p THEN b.merged ELSE s.id END AS id,
      CASE WHEN s.p = b.p THEN b.next_id WHEN s.np = b.p THEN b.merged ELSE s.nid END AS nid
    FROM st s JOIN pair b ON s.w = b.w WHERE s.p <> b.np) u
  LEFT JOIN merges m ON m.pair = u.id::BIGINT * 4294967296 + u.nid
), done AS (SELECT w, it FROM st GROUP BY w, it HAVING count(rk) = 0)
SELECT st.w, st.p, st.id FROM st JOIN done USING (w, it)
"""
#: Places count through all pieces of a block, so one ordered aggregation serves them all; w and size tell where each piece ends.
_GATHER = """
SELECT list(t.w ORDER BY t.p) AS w, list(t.id ORDER BY t.p) AS ids, list(length(v.latin) ORDER BY t.p) AS size, string_agg(v.latin, '' ORDER BY t.p) AS latin
FROM tokens t JOIN vocabulary v USING (id)
"""
_DECODE = "SELECT t.w AS w, string_agg(v.latin, '' ORDER BY t.p) AS latin FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.w"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def java_pattern(pattern: str) -> str:
    """The public pattern with \\s spelled out as Unicode's white space, which is what the tokenizer's engine reads."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def contract_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """ids with the leftmost pair of least rank contracted until none is left; neighbours are linked, pairs wait in a heap."""
    n = len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    pair = lambda i: merges.get(ids[i] << 32 | ids[after[i]]) if after[i] >= 0 else None
    waiting = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := pair(i)) is not None]
    heapq.heapify(waiting)
    while waiting:
        rank, i, left, right = heapq.heappop(waiting)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue  # one of the two has gone into another token
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (low := pair(k)) is not None:
                heapq.heappush(waiting, (low, k, ids[k], ids[after[k]]))
    return [t for t in ids if t >= 0]


#: A piece's ids and the bytes that they decode to: plain tuples, which the garbage collector needn't visit again.
Piece = tuple[np.ndarray, bytes]
IDS, DECODED = range(2)


def laid(x: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and values of a binary array that begins where its buffers do."""
    if not len(x):
        return np.zeros(1, np.int32), pa.py_buffer(b"")
    return np.frombuffer(x.buffers()[1], np.int32)[: len(x) + 1], x.buffers()[2]


def each(x: pa.Array) -> Iterator[memoryview]:
    """The values of a binary array, not copied."""
    at, values = laid(x)
    values, at = memoryview(values), at.tolist()
    return (values[a:b] for a, b in zip(at, at[1:], strict=False))


class Codec:
    """Merge table and memory of one Python worker."""

    _of: dict[str, Codec] = {}

    @classmethod
    @contextlib.contextmanager
    def of(cls, path: str) -> Iterator[Codec]:
        """The worker's codec for one task; after it only the merge table stays, as other stages need the memory."""
        if path not in cls._of:
            cls._of[path] = cls(read_ranks(path))
        try:
            yield cls._of[path]
        finally:
            cls._of[path]._forget()
            pa.default_memory_pool().release_unused()

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pairs = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.merges = dict(zip(pairs.tolist(), merged, strict=True))
        self._fill("merges", {"pair": pairs, "rank": np.array(merged, np.int32)})
        self._fill("vocabulary", {"id": np.array(list(ranks.values()), np.int32), "latin": [t.decode("latin-1") for t in ranks]})
        #: Each id in decimal and a space.
        self.decimal = pa.array([b"%d " % i for i in range(max(ranks.values()) + 1)], pa.binary())
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._forget()

    def _fill(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _forget(self) -> None:
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}
        self.bytes = 0

    def _remember(self, found: dict[str, Piece]) -> None:
        if len(self.young) >= MEMORY or self.bytes > REMEMBERED:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.young.update(found)
        self.bytes += sum(len(x[DECODED]) for x in found.values())

    def _contract_long(self, piece: str) -> Piece:
        ids = np.array(contract_long(self.byte_ids[np.frombuffer(piece.encode(), np.uint8)].tolist(), self.merges), np.int32)
        row = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
        return ids, self.decode(row)[0]

    def _contract(self, pieces: list[str]) -> Iterator[Piece]:
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.append(flat[1:], np.int32(-1))
        after[np.cumsum(lengths) - 1] = -1
        self.db.register("start", pa.table({"w": np.repeat(np.arange(len(raw), dtype=np.int32), lengths), "p": np.arange(len(flat)), "id": flat, "nid": after}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE tokens AS {_CONTRACT}")
        out = self.db.sql(_GATHER).to_arrow_table()
        self.db.execute("DROP TABLE tokens")
        self.db.unregister("start")
        w, ids, size = (out[c].combine_chunks().flatten().to_numpy() for c in ("w", "ids", "size"))
        decoded = out["latin"][0].as_py().encode("latin-1")
        ends = np.searchsorted(w, np.arange(len(raw)), side="right")
        text_ends = np.cumsum(size, dtype=np.int64)[ends - 1].tolist()
        ends = ends.tolist()
        for a, b, c, d in zip([0, *ends], ends, [0, *text_ends], text_ends, strict=False):
            yield ids[a:b].copy(), decoded[c:d]

    def contracted(self, pieces: list[str]) -> list[Piece]:
        """What these distinct pieces contract to, remembered or made now."""
        found: dict[str, Piece] = {}
        block, rows, kept = [], 0, {}

        def make() -> None:
            made = dict(zip(block, self._contract(block), strict=True))
            found.update(made)
            self._remember(made)

        young, old = self.young.get, self.old.get
        for piece in pieces:
            known = young(piece)
            if known is None and (known := old(piece)) is not None:
                kept[piece] = known
            if known is None and (size := len(piece.encode())) > LONG:
                known = self._contract_long(piece)
            if known is not None:
                found[piece] = known
                continue
            if len(block) == BLOCK or rows + size * size > BLOCK_ROWS:
                make()
                block, rows = [], 0
            block.append(piece)
            rows += size * size
        if block:
            make()
        self._remember(kept)
        return list(map(found.__getitem__, pieces))

    def rows(self, pieces: pa.ListArray) -> tuple[pa.ListArray, pa.Array]:
        """For a batch of piece lists: each row's ids, and the bytes that they decode to. Each distinct piece is looked up once, and what it
        contracts to is laid in the rows' order by Arrow."""
        first = pieces.offsets[0].as_py()
        ends = pieces.offsets.to_numpy() - first
        coded = pieces.values.slice(first, int(ends[-1])).dictionary_encode()
        made = self.contracted(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist makes a scalar of each
        ids = pa.array([x[IDS].tobytes() for x in made], pa.binary()).take(coded.indices)
        decoded = pa.array([x[DECODED] for x in made], pa.binary()).take(coded.indices)
        begins, flat = laid(ids)
        at, text = laid(decoded)
        rows = pa.ListArray.from_arrays(pa.array(begins[ends] // 4), pa.Array.from_buffers(pa.int32(), int(begins[-1]) // 4, [None, flat]))
        return rows, pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(at[ends]), text])

    def decimals(self, ids: pa.ListArray) -> Iterator[memoryview]:
        """Each row's ids in decimal, joined by spaces."""
        ends = ids.offsets.to_numpy()
        at, text = laid(self.decimal.take(ids.values))
        text = memoryview(text)
        for a, b in zip(at[ends].tolist(), at[ends[1:]].tolist(), strict=False):
            yield text[a : max(a, b - 1)]

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """Decodes id lists by ordered aggregation; an id that the vocabulary lacks is an error."""
        offsets = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int32)
        lengths = np.diff(offsets)
        self.db.register("tokens_in", pa.table({"w": np.repeat(np.arange(len(lengths)), lengths), "p": np.arange(len(flat)), "id": flat}))
        if self.db.execute("SELECT count(*) FROM tokens_in ANTI JOIN vocabulary USING (id)").fetchall()[0][0]:
            raise ValueError("ids that the vocabulary lacks")
        out = self.db.sql(_DECODE.replace("tokens t", "tokens_in t")).to_arrow_table()
        self.db.unregister("tokens_in")
        found = [b""] * len(lengths)
        for w, latin in zip(out["w"].to_pylist(), out["latin"].to_pylist(), strict=True):
            found[w] = latin.encode("latin-1")
        return found


def pieces(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """keep and the pieces of each text, as array<string>."""
    return df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0)).alias("pieces"))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int> of each text's tokens."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec.of(ranks_path) as codec:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), codec.rows(batch.column(1))[0]], names=[id_col, "ids"])

    source = pieces(df, text_col, pattern, id_col)
    return source.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded binary; null id lists are read as empty."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec.of(ranks_path) as codec:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(batch.column(1)), pa.binary())], names=[id_col, "decoded"])

    source = df.select(id_col, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return source.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")


def encode_checked(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids, decoded_sha256; the decoded bytes are compared with the text's, and a difference is an error."""
    arrow_limits(df.sparkSession, 1024)  # the more texts at once, the more pieces are the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec.of(ranks_path) as codec:
            for batch in batches:
                ids, decoded = codec.rows(batch.column(2))
                if not decoded.equals(pc.fill_null(batch.column(1), "").cast(pa.binary())):
                    raise ValueError("a text is not what its ids decode to")
                digests = [hashlib.sha256(x).hexdigest() for x in each(decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array(digests, pa.string())], names=[id_col, "n_tokens", "ids", "decoded_sha256"])

    source = pieces(df, text_col, pattern, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: digests of encode()'s ids and of what they decode to.

    Ids and decoded bytes are those of the same recursive and ordered queries as in encode() and decode();
    as decoding is a homomorphism, each distinct piece is decoded once and the bytes joined in the text's order.
    """
    arrow_limits(df.sparkSession, 1024)  # the more texts at once, the more pieces are the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec.of(ranks_path) as codec:
            for batch in batches:
                ids, decoded = codec.rows(batch.column(1))
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()) for rows in (codec.decimals(ids), each(decoded))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(ids).cast(pa.int64()), *digests], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = pieces(df, text_col, pattern, id_col)
    return source.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

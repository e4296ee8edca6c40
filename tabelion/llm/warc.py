"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress independently. A bundle ends with a seek table in a skippable frame,
as in the public seekable format, so a reader needs the file's end and one frame to reach a record. The index maps
record identifiers to (bundle, frame, offset in the frame, length).

Of records with equal payloads of at least min_bytes, that with the smallest identifier is a response and the others
are revisits that refer to it. Null payloads are empty, null urls leave the target header out, and rows with a null
identifier are responses. Repeated rows are written each; with the same identifier, both are responses.

Bundles are written under a name of their own for each task attempt, and only bundles that the written index names
are read, so lost executors and repeated tasks leave nothing behind that counts. Python's file layer is pyarrow's, which
takes file:, hdfs:, s3: and gs: addresses alike.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabelion.llm.common import Stages, arrow_limits

#: Fixed values of the seekable format: magic of the skippable frame, magic of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
#: Frames read together, and raw bytes read by a task.
READ_FRAMES, READ_BYTES = 32, 32 << 20
#: Repeated digests that are sent to all tasks (40 characters each); more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
INDEX = "record_id long, bundle string, frame int, at int, length int"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"]).encode() + block + b"\r\n\r\n"


def parse(raw: memoryview) -> Iterator[dict]:
    """The records of one frame, one after the other; a payload that its digest contradicts is an error."""
    data, at = bytes(raw), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if head["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield head | {"length": length, "digest": digest, "payload": payload}
        at = end + 8 + size


def page_of(urn: str | None) -> int | None:
    found = urn[len("<urn:page:") : -1] if urn else "None"
    return None if found == "None" else int(found)


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


class Bundle:
    """A bundle that is being written."""

    def __init__(self, files: fs.FileSystem, path: str, level: int):
        import zstandard

        self.path, self.out, self.packer = path, files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.open, self.size, self.written = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Where the record goes: frame and offset in it."""
        place = len(self.frames), self.size
        self.open.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()


def frames_of(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, packed size, raw size) of each frame, from the seek table at the file's end."""
    size = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    table, found, at = file.read_at(8 * n, size - 9 - 8 * n), [], 0
    for packed, raw in struct.iter_unpack("<II", table):
        found.append((at, packed, raw))
        at += packed
    return found


def frame(file: pa.NativeFile, at: tuple[int, int, int]) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(file.read_at(at[1], at[0]), max_output_size=at[2])


def mark_revisits(df: DataFrame, id_col: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """df with payload as binary and refers_to. Only digests that occur again are joined; while these are few, payloads stay where they are."""
    df = df.withColumn(payload, F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")).withColumn("__digest", F.sha1(payload))
    again = df.where(F.octet_length(payload) >= min_bytes).groupBy("__digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    refers = F.when((F.octet_length(payload) >= min_bytes) & (F.col("__first") < F.col(id_col)), F.col("__first"))
    return df.join(again, "__digest", "left").withColumn("refers_to", refers).drop("__digest", "__first")


def write(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload: str = "html", min_bytes: int = 0, level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Index rows of the bundles written under root; the bundles are written when the index is."""
    arrow_limits(df.sparkSession)
    marked = mark_revisits(df.select(F.col(id_col).cast("long").alias(id_col), url_col, payload), id_col, payload, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        files.create_dir(base, recursive=True)
        bundle = None
        for batch in batches:
            rows = []
            for page, url, body, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(files, f"{base}/{uuid.uuid4().hex}.warc.zst", level)
                raw = record(page, url, body, refers, date)
                rows.append((page, bundle.path, *bundle.add(raw), len(raw)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["record_id", "bundle", "frame", "at", "length"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("record_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32())]))
        if bundle:
            bundle.close()

    return marked.select(id_col, url_col, payload, "refers_to").mapInArrow(run, INDEX)


def fetch(index: DataFrame, root: str) -> DataFrame:
    """record_id and raw record of each index row, each by its seek table and one frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_root(root)
        for batch in batches:
            ids, raw = [], []
            for page, path, k, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(path) as file:
                    ids.append(page)
                    raw.append(frame(file, frames_of(file)[k])[at : at + length])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["record_id", "record"])

    return index.select("record_id", "bundle", "frame", "at", "length").mapInArrow(run, "record_id long, record binary")


def read(index: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles that the index names, frame after frame; frames are shared out over tasks."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if with_payload else 5]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_root(root)
        for batch in batches:
            for path, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(path) as file:
                    table = frames_of(file)
                    for k in sorted(wanted):
                        rows = [(page_of(x["WARC-Record-ID"]), x["length"], x["digest"], x["WARC-Type"], page_of(x.get("WARC-Refers-To")), x["payload"])[: len(names)] for x in parse(memoryview(frame(file, table[k])))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    parts = index.groupBy("bundle", F.floor(F.col("frame") / READ_FRAMES).alias("part")).agg(F.collect_set("frame").alias("frames"), F.sum("length").alias("bytes"))
    size = parts.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(1, min(size["n"], math.ceil((size["bytes"] or 0) / READ_BYTES)))  # a stated number, as the index is too small to be split by its own size
    parts = parts.select("bundle", "frames").repartition(tasks, "bundle", "frames")
    return parts.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes df into bundles in the shared folder and reads them back."""
    stages = Stages(df.sparkSession, "warc")
    root = stages.path("bundles")
    return read(stages.keep(write(df, root, id_col, url_col, payload, min_bytes), "index"), root)
